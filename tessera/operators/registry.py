"""Registries of reviewed sources: the first entry that fits a URL, and what a seed URL resolves to.

URLs and patterns never meet pair by pair. A URL has keys (itself, its prefixes of the lengths that
occur, the suffixes of its host, its runs of few characters), a pattern has one, and they are
joined by equality; only ``contains`` patterns are then looked for in the URLs that have their rarest
run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import evidence, urls
from tessera.session import SENT_BYTES, sent

#: Characters in the run by which a ``contains`` pattern is found; a shorter pattern is a run itself.
RUN = 4


def pattern_form(value: Column) -> Column:
    """A pattern's value as it is compared: URLs in approval form, others in lower case; null for nothing."""
    other = F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), r"^www\.", ""), "/$", "")), F.lit(""))
    return F.when(value.rlike("(?i)^https?://"), urls.approval_form(value)).otherwise(other)


def suffixes(host: Column) -> Column:
    """A host and all domains above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _runs(form: Column, sizes: Column) -> Column:
    """All runs of the given lengths, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(0), F.length(form) - n), lambda i: F.substr(form, i + 1, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda n: n <= F.length(form)), of)))


def _marked(kind: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))


def first_fits(forms: DataFrame, patterns: DataFrame) -> DataFrame:
    """form, record_id: for each distinct approval form the record of the first pattern that fits it.

    ``patterns`` has ordinal, record_id, kind and value: ``exact`` is the whole form, ``prefix`` its
    start, ``contains`` a part of it, ``host`` its host or a domain above. Unknown kinds, null and
    empty values fit nothing; forms that nothing fits are not there.
    """
    forms = forms.select("form").filter("form is not null").distinct()
    known = patterns.select("ordinal", "record_id", "kind", pattern_form(F.col("value")).alias("value")).filter("value is not null")
    # Two small lists of numbers: lengths that patterns of a kind have; and the bytes of all patterns, twice their values and 64 a row.
    n = F.when(F.col("kind") == "prefix", F.length("value")).when(F.col("kind") == "contains", F.least(F.length("value"), F.lit(RUN)))
    weight = F.sum(2 * F.octet_length("value") + F.coalesce(F.octet_length(F.col("record_id").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col("ordinal").cast("string")), F.lit(0)) + 64)
    kinds = known.filter("kind in ('exact', 'prefix', 'host', 'contains')").groupBy("kind").agg(F.collect_set(n).alias("n"), weight.alias("size")).collect()
    lengths, size = {r.kind: sorted(r.n) for r in kinds}, sum(r["size"] for r in kinds)
    listed = lambda kind: F.array(*map(F.lit, lengths.get(kind, []))).cast("array<int>")
    form = F.col("form")
    heads = F.transform(F.filter(listed("prefix"), lambda n: n <= F.length(form)), lambda n: F.substr(form, F.lit(1), n))
    keyed = {"exact": F.array(form), "prefix": heads, "host": suffixes(urls.host(form)), "contains": _runs(form, listed("contains"))}
    each = F.concat(*(_marked(kind, keys) for kind, keys in keyed.items()))
    keys = forms.select("form", F.explode(each).alias("k")).select("form", "k.*")
    runs = known.filter("kind = 'contains'").withColumn("key", F.explode(_runs(F.col("value"), F.array(F.least(F.length("value"), F.lit(RUN))))))
    often = keys.filter("kind = 'contains'").join(sent(runs.select("key").distinct()), "key", "left_semi").groupBy("key").count()
    rarest = Window.partitionBy("ordinal", "record_id", "value").orderBy("count", "key")
    probes = runs.join(often.hint("merge"), "key").withColumn("_r", F.row_number().over(rarest)).filter("_r = 1").select("ordinal", "record_id", "kind", "value", "key")
    index = known.filter("kind != 'contains'").withColumn("key", F.col("value")).unionByName(probes)
    # A pattern has one key, so the patterns' own size is the index's; keys of the forms always stay where they are.
    index = F.broadcast(index) if size <= SENT_BYTES else index.hint("merge")
    met = keys.join(index, ["kind", "key"]).filter((F.col("kind") != "contains") | F.col("form").contains(F.col("value")))
    return met.groupBy("form").agg(F.min_by("record_id", "ordinal").alias("record_id"))


def pattern_match(pages: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """Every row of ``pages`` with the record_id of the first pattern that fits its URL, null if none does."""
    rows = pages.withColumn("_form", urls.approval_form(F.col(url)))
    found = first_fits(rows.select(F.col("_form").alias("form")), patterns).withColumnRenamed("form", "_form")
    return rows.join(found.hint("merge"), "_form", "left").drop("_form")


def publisher_host(value: Column) -> Column:
    """The host of a URL or of a bare name, without ``www.``; null for nothing."""
    low = F.lower(F.trim(value))
    return F.nullif(urls.host(F.when(low.contains("://"), low).otherwise(F.concat(F.lit("https://"), low))), F.lit(""))


def reviewed_hosts(records: DataFrame, patterns: DataFrame) -> DataFrame:
    """record_id, host: the hosts of a record's fallback URL and of its patterns that are URLs, each once."""
    own = records.select("record_id", F.col("fallback_url").alias("value"))
    own = own.unionByName(patterns.select("record_id", "value").filter(F.col("value").rlike("(?i)^https?://")))
    return own.select("record_id", publisher_host(F.col("value")).alias("host")).filter("host is not null").distinct()


def is_approved(record: Column, logic: Column) -> Column:
    """Whether a record (usage, logic_ids, sections) is in scope for a logic (logic_id, catalog, registry_ids, section).

    A direct record serves every logic of the catalog; else one of its logics or sections has to be
    the logic's. A record that names neither is in scope for all.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    catalog = no(logic["catalog"]) & no(record["usage"] == "direct")
    named = no(F.array_contains(record["logic_ids"], logic["logic_id"])) | no(F.arrays_overlap(record["logic_ids"], logic["registry_ids"]))
    return catalog | named | no(F.array_contains(record["sections"], logic["section"])) | (record["logic_ids"].isNull() & record["sections"].isNull())


_RECORD = ["usage", "logic_ids", "sections"]
_LOGIC = ["logic_id", "catalog", "registry_ids", "section"]


def _struct(names: list[str]) -> Column:
    return F.struct(*(F.col(n) for n in names))


def _exact(rows: DataFrame, records: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` (form and logic columns) with ``exact_id``: the first fitting record, if direct and in scope."""
    found = first_fits(rows, patterns).join(records.select("record_id", *_RECORD), "record_id")
    met = rows.join(found, "form", "left")
    fits = F.coalesce((F.col("usage") == "direct") & is_approved(_struct(_RECORD), _struct(_LOGIC)), F.lit(False))
    return met.withColumn("exact_id", F.when(fits, F.col("record_id"))).drop("record_id", *_RECORD)


def _derived(record: Column, form: Column) -> Column:
    return F.concat(F.lit("catalog-"), record, F.lit("-"), evidence.token(form))


def resolve_seeds(seeds: DataFrame, records: DataFrame, patterns: DataFrame) -> DataFrame:
    """seed_id, approval_id, reviewed_id, form: what each seed URL is approved as.

    ``seeds``: seed_id, url, domain, requested (array of record ids) and the logic's columns;
    ``records``: record_id, ordinal, fallback_url, usage, logic_ids, sections; ``patterns`` as for
    first_fits(). A seed is the exact record that fits it first, if that is direct and in scope.
    Else it gets an approval of its own below the first direct record in scope (one of the requested,
    if any are) that has a reviewed host equal to its own or above it. Only https seeds whose declared
    domain, if any, is their host resolve; the others have nulls.
    """
    rows = seeds.withColumn("form", urls.approval_form(F.col("url"))).withColumn("host", urls.host(F.col("form")))
    declared = publisher_host(F.coalesce("domain", F.lit("")))
    sound = F.coalesce(F.col("form").startswith("https://") & (declared.isNull() | (declared == F.col("host"))), F.lit(False))
    good = _exact(rows.filter(sound).select("seed_id", "form", "host", "requested", *_LOGIC), records, patterns)
    open_ = good.filter("exact_id is null").withColumn("_suffix", F.explode(suffixes(F.col("host"))))
    direct = reviewed_hosts(records, patterns).join(records.filter("usage = 'direct'").select("record_id", "ordinal", *_RECORD), "record_id")
    asked = F.coalesce(F.size("requested"), F.lit(0)) <= 0
    met = open_.join(direct, F.col("_suffix") == direct["host"]).filter(is_approved(_struct(_RECORD), _struct(_LOGIC)) & (asked | F.array_contains("requested", F.col("record_id"))))
    reviewed = met.groupBy("seed_id").agg(F.min_by("record_id", "ordinal").alias("reviewed_id"))
    out = seeds.select("seed_id").join(good.select("seed_id", "form", "exact_id"), "seed_id", "left").join(reviewed, "seed_id", "left")
    own = F.coalesce("exact_id", "reviewed_id")
    return out.select("seed_id", F.coalesce("exact_id", _derived(F.col("reviewed_id"), F.col("form"))).alias("approval_id"), own.alias("reviewed_id"), F.when(own.isNotNull(), F.col("form")).alias("form"))


def resolve_same_publisher(candidates: DataFrame, records: DataFrame, patterns: DataFrame) -> DataFrame:
    """candidate_id, approval_id, reviewed_id: approvals of search results on a seed's publisher.

    ``candidates``: candidate_id, url, the seed's reviewed_id and seed_form, and the logic's columns.
    Both URLs must be https and on reviewed hosts of the record, which must be direct and in scope. A
    candidate with an exact record of its own takes that; the others get an approval of their own.
    """
    rows = candidates.withColumn("form", urls.approval_form(F.col("url")))
    trusted = rows.join(records.filter("usage = 'direct'").select(F.col("record_id").alias("reviewed_id"), *_RECORD), "reviewed_id")
    trusted = trusted.filter(is_approved(_struct(_RECORD), _struct(_LOGIC)) & F.col("form").startswith("https://") & F.col("seed_form").startswith("https://")).drop(*_RECORD)
    hosts = reviewed_hosts(records, patterns).withColumnRenamed("record_id", "reviewed_id")
    for name in ("form", "seed_form"):
        below = trusted.select("candidate_id", "reviewed_id", F.explode(suffixes(urls.host(F.col(name)))).alias("host"))
        trusted = trusted.join(below.join(hosts, ["reviewed_id", "host"]).select("candidate_id").distinct(), "candidate_id", "left_semi")
    found = _exact(trusted.select("candidate_id", "reviewed_id", "form", *_LOGIC), records, patterns)
    found = found.select("candidate_id", F.coalesce("exact_id", _derived(F.col("reviewed_id"), F.col("form"))).alias("approval_id"), F.coalesce("exact_id", "reviewed_id").alias("reviewed_id"))
    return candidates.select("candidate_id").join(found, "candidate_id", "left")
