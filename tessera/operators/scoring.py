"""Scores of evidence: authority, freshness, relevance, and what decides about a claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import seconds_between
from tessera.functions.text import phrase_form


def authority(host: Column, title: Column, hinted: Column) -> Column:
    """45, plus what the domain and title say, within 0 and 100. Fixed values."""
    score = (
        F.lit(45)
        + F.when(host.rlike(r"(^|\.)gov(\.|$)"), 35).otherwise(0)
        + F.when(host.rlike(r"\.int$"), 30).otherwise(0)
        + F.when(host.rlike(r"\.edu(\.|$)"), 15).otherwise(0)
        + F.when(host.rlike(r"\.org$"), 12).otherwise(0)
        + F.when(hinted, 30).otherwise(0)
        + F.when(F.lower(title).rlike("regulator|ministry|commission|authority|central bank"), 18).otherwise(0)
        - F.when(host.rlike("blog"), 12).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def freshness(day: Column, as_of: Column) -> Column:
    """100 to half a year, 90 to a year, 75 to three, 60 to five, then 40; 45 undated, 20 in the future."""
    days = seconds_between(day.cast("timestamp_ntz"), as_of) / 86400
    return (
        F.when(day.isNull(), 45).when(days < 0, 20).when(days <= 180, 100).when(days <= 365, 90).when(days <= 1095, 75).when(days <= 1825, 60).otherwise(40)
    )


def relevance(text: Column, country: str, sector: Sequence[str], terms: Sequence[str]) -> Column:
    """25 for the country, 10 for each sector word, 6 for each term, 100 at most. Fixed values.

    The text is brought into its plain form once, as the argument of a fold over the phrases.
    """
    worth = [(country, 25), *((w, 10) for w in sector), *((w, 6) for w in terms)]
    phrases = F.array(*(F.struct(phrase_form(F.lit(w)).alias("phrase"), F.lit(n).alias("worth")) for w, n in worth))
    plain = F.array(phrase_form(text))
    points = F.transform(plain, lambda t: F.aggregate(phrases, F.lit(0), lambda sum_, p: sum_ + F.when(t.contains(p["phrase"]), p["worth"]).otherwise(0)))
    return F.least(F.lit(100), points[0])


def ranked_sources(df: DataFrame, key: str, most: int = 24) -> DataFrame:
    """The best by 0.45 authority + 0.35 relevance + 0.20 freshness that are relevant (20) or of authority (75)."""
    score = F.round(F.lit(0.45) * F.col("authority") + F.lit(0.35) * F.col("relevance") + F.lit(0.20) * F.col("freshness"), 4)
    good = (F.col("relevance") >= 20) | (F.col("authority") >= 75)
    return df.filter(good).withColumn("score", score).orderBy(F.desc("score"), key).limit(most)


def verdict(rules: dict[str, Column]) -> Column:
    """struct(passed, reasons): the names of the rules that fail, in order."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("reasons"))


def first_reason(rules: dict[str, Column]) -> Column:
    """The first rule that fails; null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))


def first_success(df: DataFrame, group: str, rank: str, ok: str, label: str) -> DataFrame:
    """By group: the label of the lowest rank that succeeded, and those that failed before it."""
    marked = df.groupBy(group).agg(
        F.min_by(label, F.when(F.col(ok), F.col(rank))).alias("winner"), F.min(F.when(F.col(ok), F.col(rank))).alias("at"),
        F.sort_array(F.collect_list(F.when(~F.col(ok), F.struct(rank, label)))).alias("bad"),
    )
    before = F.filter("bad", lambda b: F.col("at").isNull() | (b[rank] < F.col("at")))
    return marked.select(group, "winner", F.size(before).alias("failures"), F.array_join(F.slice(F.transform(before, lambda b: b[label].cast("string")), 1, 3), "; ").alias("first_failures"))


def scope_bucket(esg: Column, credit: Column, least: float = 0.6) -> Column:
    """esg, credit, both or neither, by thresholds."""
    return F.when((esg >= least) & (credit >= least), "both").when(esg >= least, "esg").when(credit >= least, "credit").otherwise("neither")


def selection_score(country: Column, sector: Column, specialist: Column, seeded: Column, specificity: Column, fresh: Column, balance: Column, repeats: Column) -> Column:
    """A candidate's points; null where its country does not fit at all."""
    place = F.when(country == "own", 40).when(country == "region", 12)
    field = F.when(specialist, F.when(sector == "own", 34).when(sector == "near", 26).when(sector == "all", 22).otherwise(20)).otherwise(
        F.when(sector == "own", 30).when(sector == "near", 20).otherwise(12)
    )
    extra = F.when(specialist, 12).otherwise(0) + F.when(seeded, 18).otherwise(0)
    return place + field + extra + F.least(specificity, F.lit(10)) + F.least(fresh, F.lit(7)) + F.least(balance, F.lit(4)) - F.least(repeats, F.lit(6))
