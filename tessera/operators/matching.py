"""Names to companies, URLs to registries and publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about which company is meant. Fixed values.
LEGAL_FORMS = ["s.a.", "ltd", "inc", "co", "company", "corporation", "limited", "plc", "corp"]


def name_words(name: Column) -> Column:
    """The words between white space, in lower case; an empty name is one empty word."""
    return F.split(F.lower(name), r"\s+")


def name_tokens(name: Column) -> Column:
    """The words without legal forms; repeated words stay."""
    return F.filter(name_words(name), lambda w: ~w.isin(LEGAL_FORMS))


def _least_id(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    best = Window.partitionBy(key).orderBy(*order, "company_id")
    return df.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def fuzzy_match(names: DataFrame, companies: DataFrame, least_overlap: float = 0.8, least_score: float = 0.6) -> DataFrame:
    """name, company_id, company, score: the best company of each name.

    ``names`` has name; ``companies`` company_id, company. An equal name (ignoring case) wins with
    score 1. Otherwise 0.7 of the share of the name's tokens that the company has plus 0.3 of the
    ratio of lengths; the smallest company_id among equals. Null names match nothing.

    A company with that share of a name's n tokens lacks at most n - ceil(share * n) of them, so
    one more than that of the name's rarest tokens suffice to find it: frequent words join nothing
    and are only counted. Companies of one spelling score alike, so only the smallest id of each is compared.
    """
    left = names.select("name").filter("name is not null").distinct()
    right = companies.filter("company is not null").groupBy("company").agg(F.min("company_id").alias("company_id")).select("company_id", "company")
    equal = left.join(right.withColumn("_low", F.lower("company")), F.lower("name") == F.col("_low")).drop("_low")
    equal = _least_id(equal, "name").withColumn("score", F.lit(1.0))
    rest = left.join(equal.select("name"), "name", "left_anti").withColumn("words", name_tokens(F.col("name")))
    own = right.withColumn("own", F.array_distinct(name_tokens(F.col("company"))))
    posted = own.select("company_id", F.explode("own").alias("word"))
    often = posted.groupBy("word").agg(F.count("*").alias("n"))
    asked = rest.select("name", F.size("words").alias("_n"), F.explode("words").alias("word")).distinct()
    rare = Window.partitionBy("name").orderBy(F.coalesce("n", F.lit(0)), "word")
    spare = F.col("_n") - F.ceil(F.lit(least_overlap) * F.col("_n")) + 1
    probes = asked.join(often, "word", "left").withColumn("_r", F.row_number().over(rare)).filter(F.col("_r") <= spare)
    met = probes.join(posted, "word").select("name", "company_id").distinct().join(rest, "name").join(own, "company_id")
    share = F.size(F.filter("words", lambda w: F.array_contains("own", w))) / F.size("words")
    lengths = 1 - F.abs(F.length("name") - F.length("company")) / F.greatest(F.length("name"), F.length("company"))
    scored = met.filter(share >= least_overlap).withColumn("score", F.round(0.7 * share + 0.3 * lengths, 6))
    best = _least_id(scored.filter(F.col("score") >= least_score), "name", F.desc("score"))
    return equal.unionByName(best.select("name", "company_id", "company", "score"))


def priority_match(names: DataFrame, companies: DataFrame) -> DataFrame:
    """name, company_id, company, tier: an equal name (0), else a company whose words hold all of the
    name's words (1), the smallest company_id of either; names without a match are not there."""
    left = names.select("name").filter("name is not null").distinct()
    right = companies.filter("company is not null").select("company_id", "company")
    equal = left.join(right.withColumn("_low", F.lower(F.trim("company"))), F.lower(F.trim("name")) == F.col("_low")).drop("_low")
    equal = _least_id(equal, "name").withColumn("tier", F.lit(0))
    rest = left.join(equal.select("name"), "name", "left_anti")
    words = lambda c: F.array_distinct(F.filter(name_words(F.trim(c)), lambda w: w != ""))
    own = right.withColumn("own", words("company"))
    posted = own.select("company_id", F.explode("own").alias("word"))
    often = posted.groupBy("word").agg(F.count("*").alias("n"))
    asked = rest.withColumn("words", words("name")).select("name", "words", F.explode("words").alias("word"))
    first = Window.partitionBy("name").orderBy("n", "word")
    rarest = asked.join(often, "word").withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    met = rarest.join(posted, "word").join(own, "company_id").filter(F.size(F.array_except("words", "own")) == 0)
    found = _least_id(met, "name").select("name", "company_id", "company").withColumn("tier", F.lit(1))
    return equal.unionByName(found)


def publisher(pages: DataFrame, policy: DataFrame, host: str = "host") -> DataFrame:
    """The policy (domain, label) of the longest domain that is the host or a suffix of it.

    Hosts are spread over their suffixes, so the join is by equality.
    """
    hosts = pages.select(host).distinct()
    parts = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    met = hosts.select(host, F.explode(suffixes).alias("domain")).join(policy, "domain")
    best = met.groupBy(host).agg(F.max_by("label", F.length("domain")).alias("label"), F.max_by("domain", F.length("domain")).alias("domain"))
    return pages.join(best, host, "left")
