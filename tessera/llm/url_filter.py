"""URL filtering by a temporal join with dated list entries.

A list is a log of dated entries: at ``since`` a pattern starts (``add``) or stops
(``remove``) to be listed. Entries of one list, kind and pattern become validity intervals
``[since, until)`` by looking one entry ahead. A capture is judged by what was listed when
it was fetched, not by the list of today.

Three kinds of pattern: ``host`` (that host alone), ``domain`` (a host and all below it) and
``prefix`` (host and the beginning of the path, cut at whole segments). A capture therefore
has a few keys: its host, each suffix of the host, each prefix of the path. The as-of join
is an equality join on (kind, pattern, month): intervals are spread over the months they
touch, a capture has one month, so a host with any share of the captures is met a month
at a time, and Spark may split its rows further. An inequality then checks the exact time.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def url_parts(url: Column) -> dict[str, Column]:
    """host (lower case, without user, port and trailing dot) and path (from the first slash)."""
    rest = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(authority, r"^(?:.*@)?([^:]*)", 1)), r"\.+$", "")
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return {"host": host, "path": F.when(path == "", F.lit("/")).otherwise(path)}


def url_keys(url: Column, segments_listed: int | None = None) -> Column:
    """All (kind, pattern) structs that can list a URL.

    ``segments_listed``, the most path segments of any prefix listed, spares longer ones.
    """
    part = url_parts(url)
    labels = F.split(part["host"], r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    segments = F.filter(F.split(part["path"], "/"), lambda x: x != "")
    n = F.size(segments) if segments_listed is None else F.least(F.size(segments), F.lit(segments_listed))
    prefixes = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.concat(F.array(part["host"]), F.slice(segments, 1, i)), "/").alias("pattern")),
    )
    host = F.array(F.struct(F.lit("host").alias("kind"), part["host"].alias("pattern")))
    return F.concat(host, suffixes, prefixes)


def _pattern() -> Column:
    """An entry's pattern as url_keys() writes it: hosts in lower case, paths as they are, no empty segments."""
    whole = F.trim("pattern")
    parts = F.split(whole, "/")
    prefix = F.array_join(F.concat(F.array(F.lower(parts[0])), F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != "")), "/")
    return F.when(F.col("kind") == "prefix", prefix).otherwise(F.lower(whole))


def validity(entries: DataFrame) -> DataFrame:
    """list_name, kind, pattern, since, until: the times at which a pattern was listed.

    ``entries`` has list_name, kind, pattern, action ('add' or 'remove') and since. An entry
    holds until the next of its pattern; until is null for the last. At one time a removal
    outweighs an addition. Entries without list, kind, pattern or time count for nothing.
    """
    named = entries.select("list_name", "kind", _pattern().alias("pattern"), "action", F.col("since").cast("timestamp_ntz").alias("since"))
    named = named.dropna()
    at_once = named.groupBy("list_name", "kind", "pattern", "since").agg(F.max(F.col("action") == "remove").alias("removed"))
    ahead = Window.partitionBy("list_name", "kind", "pattern").orderBy("since")
    spans = at_once.withColumn("until", F.lead("since").over(ahead)).filter(~F.col("removed"))
    return spans.select("list_name", "kind", "pattern", "since", "until")


def _month(time: Column) -> Column:
    return (F.year(time) * 12 + F.month(time)).cast("int")


def filter_urls(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Every capture with blocked, n_lists (lists that held it when fetched) and first_list.

    Returns key, url, fetched_at, blocked, n_lists, first_list (the smallest list name; null if
    none). A capture without URL or time is never blocked. Repeated rows keep their number: all
    captures with one URL and time are judged once. Empty captures give no rows, empty
    entries block nothing. Extra columns play no part.
    """
    rows = captures.select(F.col(key), F.col(url).alias("url"), F.col(fetched).cast("timestamp_ntz").alias("fetched_at"))
    spans = validity(entries)
    longest = entries.filter("kind = 'prefix'").agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    newest = F.lit(rows.agg(F.max("fetched_at").cast("string")).first()[0]).cast("timestamp_ntz")
    last = F.least(F.coalesce(F.col("until"), newest), newest)
    months = spans.filter(F.col("since") <= newest)
    months = months.withColumn("month", F.explode(F.sequence(_month(F.col("since")), F.greatest(_month(F.col("since")), _month(last)))))
    asked = rows.filter(F.col("url").isNotNull() & F.col("fetched_at").isNotNull()).select("url", "fetched_at").distinct()
    keyed = asked.withColumn("month", _month(F.col("fetched_at"))).withColumn("k", F.explode(F.array_distinct(url_keys(F.col("url"), longest))))
    keyed = keyed.select("url", "fetched_at", "month", "k.kind", "k.pattern")
    active = keyed.join(months, ["kind", "pattern", "month"]).filter((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    verdict = active.groupBy(F.col("url").alias("_u"), F.col("fetched_at").alias("_t")).agg(F.countDistinct("list_name").alias("n_lists"), F.min("list_name").alias("first_list"))
    out = rows.join(verdict, (F.col("url") == F.col("_u")) & (F.col("fetched_at") == F.col("_t")), "left")
    n = F.coalesce("n_lists", F.lit(0).cast("long"))
    return out.select(key, "url", "fetched_at", (n > 0).alias("blocked"), n.alias("n_lists"), "first_list")
