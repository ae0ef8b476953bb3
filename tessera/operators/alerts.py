"""Who is due an alert, and what is new for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import any_keyword
from tessera.operators.listing import ranked


def due(prefs: DataFrame, as_of: Column) -> DataFrame:
    """Active, enabled preferences whose local hour (and for weekly ones, day) is now and that were
    not served lately: 20 hours for daily, 6 days for weekly ones.

    Without a time zone it is Asia/Dubai's, without a day Monday; hour 0 counts as 9, as does none.
    """
    here = F.from_utc_timestamp(as_of.cast("timestamp"), F.coalesce("timezone", F.lit("Asia/Dubai")))
    hour = F.when(F.coalesce("digest_hour", F.lit(0)) == 0, 9).otherwise(F.col("digest_hour"))
    day_ok = (F.col("frequency") != "weekly") | (F.lower(F.date_format(here, "EEEE")) == F.coalesce("digest_day", F.lit("monday")))
    rest = F.when(F.col("frequency") == "weekly", F.expr("interval 6 days")).otherwise(F.expr("interval 20 hours"))
    stale = F.col("last_sent").isNull() | (F.col("last_sent") < as_of - rest)
    return prefs.filter(F.col("active") & F.col("enabled") & stale & (F.hour(here) == hour) & day_ok)


def new_content(prefs: DataFrame, content: DataFrame, sent: DataFrame, as_of: Column, lookback: str, most: int = 20) -> DataFrame:
    """user_id, content_id, rank: fresh content of each preference's source with one of its keywords.

    ``prefs`` has user_id, source, keywords; ``content`` content_id, source, title, created_at.
    What was sent (user_id, content_id) stays out; ``most`` a user and source, newest first. Without
    keywords (an empty list) all titles fit, with null for keywords none.

    Many users ask for the same: content is tested and ranked once for each source and set of keywords,
    as far down as any of its users can need, which is ``most`` and the fresh content that they were sent.
    """
    fresh = content.filter(F.col("created_at") > as_of - F.expr(f"interval {lookback}")).select("content_id", "source", "title", "created_at")
    words = F.array_sort(F.array_distinct(F.transform("keywords", lambda k: F.lower(k))))
    asked = prefs.filter("keywords is not null").select("user_id", "source", words.alias("words"))
    had = sent.select("user_id", "content_id").distinct().join(fresh.select("content_id"), "content_id", "left_semi")
    known = had.groupBy("user_id").agg(F.count("*").alias("had"))
    wanted = asked.join(known, "user_id", "left").groupBy("source", "words").agg((F.coalesce(F.max("had"), F.lit(0)) + most).alias("deep"))
    met = wanted.join(fresh, "source").filter((F.size("words") == 0) | any_keyword(F.col("title"), F.col("words")))
    newest = [F.desc("created_at"), F.col("content_id")]
    lists = ranked(met, ["source", "words"], newest).filter(F.col("rank") <= F.col("deep")).select("source", "words", "content_id", "created_at")
    left = asked.join(lists, ["source", "words"]).join(had, ["user_id", "content_id"], "left_anti")
    top = ranked(left, ["user_id", "source"], newest)
    return top.filter(F.col("rank") <= most).select("user_id", "content_id", "rank")


def stuck(prefs: DataFrame, as_of: Column) -> DataFrame:
    """Digests that should have gone out more than a day ago."""
    return prefs.filter(F.col("frequency").isin("daily", "weekly") & (F.col("next_send_at") < as_of - F.expr("interval 1 day")))
