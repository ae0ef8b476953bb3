"""Activity, likes and teams. ``events`` stand for the log of both domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import ratio


def since(df: DataFrame, time: str, as_of: Column, interval: str) -> DataFrame:
    return df.filter(F.col(time) > as_of - F.expr(f"interval {interval}"))


def top_users(activity: DataFrame, users: DataFrame, most: int = 10) -> DataFrame:
    """The most active users with name and team; users that are not known are Unknown.

    ``activity`` has user_id, ``users`` user_id, name, team. The counts are cut to ``most``
    before users are looked up.
    """
    top = activity.groupBy("user_id").agg(F.count("*").alias("activity_count")).orderBy(F.desc("activity_count"), "user_id").limit(most)
    named = top.join(users, "user_id", "left")
    unknown = F.lit("Unknown")
    return named.select("user_id", F.coalesce("name", unknown).alias("name"), F.coalesce("team", unknown).alias("team"), "activity_count")


def daily(df: DataFrame, time: str, *keys: str) -> DataFrame:
    """Rows by day and keys; days without rows are not there."""
    return df.groupBy(F.col(time).cast("date").alias("day"), *keys).agg(F.count("*").alias("n"))


def hourly(df: DataFrame, time: str, *keys: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", time).cast("timestamp_ntz").alias("hour"), *keys).agg(F.count("*").alias("n"))


def merged_counts(parts: list[DataFrame], keys: list[str], value: str = "n") -> DataFrame:
    """Counts of several domains added up by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum(value).alias(value))


def team_engagement(users: DataFrame, likes: DataFrame, activity: DataFrame) -> DataFrame:
    """By team: members, likes, activity, ratios per member and the score
    (0.6 likes + 0.4 activity per member) x 100."""
    by_user = lambda df, name: df.groupBy("user_id").agg(F.count("*").alias(name))
    joined = users.join(by_user(likes, "likes"), "user_id", "left").join(by_user(activity, "activity"), "user_id", "left")
    teams = joined.groupBy(F.coalesce("team", F.lit("No Team")).alias("team")).agg(
        F.count("*").alias("members"), F.coalesce(F.sum("likes"), F.lit(0)).alias("likes"), F.coalesce(F.sum("activity"), F.lit(0)).alias("activity")
    )
    score = (F.lit(0.6) * F.col("likes") / F.col("members") + F.lit(0.4) * F.col("activity") / F.col("members")) * 100
    return teams.select(
        "team", "members", "likes", "activity",
        ratio(F.col("likes"), F.col("members")).alias("likes_per_user"),
        ratio(F.col("activity"), F.col("members")).alias("activity_per_user"),
        F.round(score, 2).alias("score"),
    )


def most_liked(content: DataFrame, likes: DataFrame, most: int = 10) -> DataFrame:
    """Content with its number of likes and the last one; ``content`` has content_id and title."""
    counts = likes.groupBy("content_id").agg(F.count("*").alias("likes"), F.max("created_at").alias("last_liked"))
    top = content.join(counts, "content_id", "left").withColumn("likes", F.coalesce("likes", F.lit(0)))
    return top.orderBy(F.desc("likes"), "content_id").limit(most)


def source_leaderboard(content: DataFrame, likes: DataFrame) -> DataFrame:
    """By source: joined rows (an article counts once a like) and different likers."""
    joined = content.join(likes, "content_id")
    return joined.groupBy("source").agg(F.count("*").alias("article_count"), F.countDistinct("user_id").alias("likers"))


def health_grade(rate: Column, bad: float = 80, poor: float = 95) -> Column:
    return F.when(rate < bad, "unhealthy").when(rate < poor, "degraded").otherwise("healthy")


def worst(status: Column) -> Column:
    """An aggregate: the worst of unhealthy, degraded and healthy."""
    rank = F.when(status == "unhealthy", 2).when(status == "degraded", 1).otherwise(0)
    return F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.max(rank) + 1)
