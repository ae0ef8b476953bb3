"""Confidence, routes and buckets of evidence records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least confidence that a claim is accepted with, and rewrites allowed. Fixed values.
TARGET, REWRITES = 75, 2
#: Words of a source's field names by the group they are shown in, the first that fits. Fixed values.
BUCKETS = {
    "Identity": ["number", "id", "display", "code", "label", "title", "category", "classification", "name"],
    "Timeline": ["date", "time", "start", "end", "deadline", "created", "updated", "opening", "placement", "submit"],
    "Commercial": ["amount", "sum", "cost", "price", "currency", "deposit", "advance", "value", "point"],
    "Parties": ["buyer", "customer", "seller", "organizer", "address", "contact", "region", "district", "bin", "tin", "inn", "fullname", "job"],
    "Process": ["status", "method", "procedure", "language", "rule", "type", "source", "qualification", "financing", "evaluation"],
    "References": ["url", "link", "path"],
}
#: What makes an indicator specific. Fixed value.
SPECIFIC = r"(?i)\d|%|usd|co2|scope|2030|2040|2050|ifrs|issb|ndc|paris|framework|policy|regulation|standard|taxonomy"


def bucket(key: Column) -> Column:
    """The group in which a field is shown; ``Additional facts`` if no word fits."""
    low = F.lower(key)
    tests = ((name, reduce(lambda a, b: a | b, (low.contains(w) for w in words))) for name, words in BUCKETS.items())
    return F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests), F.lit("Additional facts"))


def bucket_counts(records: DataFrame, key: str, keys: str) -> DataFrame:
    """bucket, n, records: how many of the records' ``keys`` (array) a group shows, and of how many different records.

    The groups are known, so each record keeps a number for each and is one row, not one for each key.
    """
    names = [*BUCKETS, "Additional facts"]
    held = records.select(key, F.transform(keys, bucket).alias("_b"))
    of = lambda name: lambda b: b == name
    each = held.groupBy(key).agg(*(F.sum(F.size(F.filter("_b", of(name)))).alias(f"_{i}") for i, name in enumerate(names)))
    sums = [f(i) for i in range(len(names)) for f in (lambda i: F.sum(f"_{i}").alias(f"n{i}"), lambda i: F.count_if(F.col(key).isNotNull() & (F.col(f"_{i}") > 0)).alias(f"r{i}"))]
    rows = F.array(*(F.struct(F.lit(name).alias("bucket"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("records")) for i, name in enumerate(names)))
    return each.agg(*sums).select(F.inline(rows)).filter("n > 0")


def derived_confidence(average: Column, model: Column, indicator: Column, sources: Column, authoritative: Column, bad_label: Column, bad_metric: Column, weak_title: Column) -> Column:
    """0.55 of the sources' mean score, 0.25 of the model's, points for detail and depth, less penalties.

    At most 96; at least TARGET with an authoritative source and no issue, else at least 35. Null
    numbers are 0 (so is the mean of no source), null flags false, a null indicator is empty.
    """
    number = lambda c: F.coalesce(c, F.lit(0))
    flag = lambda c: F.coalesce(c, F.lit(False))
    points = lambda test, worth: F.when(flag(test), worth).otherwise(0)
    raw = F.lit(0.55) * number(average) + F.lit(0.25) * number(model) + points(indicator.rlike(SPECIFIC), 10) + F.least(number(sources) * 5, F.lit(15))
    raw = raw - points(bad_label, 8) - points(bad_metric, 20) - points(weak_title, 8)
    least = F.when((number(sources) >= 1) & flag(authoritative) & ~flag(bad_label) & ~flag(bad_metric) & ~flag(weak_title), TARGET).otherwise(35)
    return F.greatest(least, F.least(F.lit(96), F.floor(raw + 0.5))).cast("int")


def verdict_issues(score: Column, recommended: Column) -> Column:
    """What the two gates of a verdict say of a score and a confidence below TARGET."""
    said = lambda name, value: F.concat(F.lit(name), F.round(value).cast("int").cast("string"), F.lit(f" is below the required {TARGET}"))
    low = F.when(score < TARGET, said("quality score ", score)), F.when(recommended < TARGET, said("evidence-grounded confidence ", recommended))
    return F.filter(F.array(*low), lambda x: x.isNotNull())


def route(passed: Column, score: Column, confidence: Column, recommended: Column, issues: Column, augmented: Column, unused_seeds: Column, can_repair: Column, attempts: Column) -> Column:
    """What follows a verification: accept, augment, repair or fail; fail where there is no verification (``passed`` is null)."""
    accept = passed & (score >= TARGET) & (F.least(confidence, recommended) >= TARGET)
    stronger = (issues > 0) | (recommended < TARGET)
    return (
        F.when(passed.isNull() | confidence.isNull(), "fail").when(accept, "accept").when(stronger & (augmented == 0) & (unused_seeds > 0), "augment").when(can_repair & (attempts <= REWRITES), "repair").otherwise("fail")
    )


def capped_confidence(confidence: Column, has_evidence: Column, grounded: Column) -> Column:
    """At most 60 without evidence, at most 70 where numbers are not grounded."""
    return F.when(~has_evidence, F.least(confidence, F.lit(60))).when(~grounded, F.least(confidence, F.lit(70))).otherwise(confidence)


#: Errors that end a run, and those that another try may mend: names, codes, phrases. Fixed values.
TERMINAL_NAMES = ["EsgDriverCandidateRejectedError", "EsgDriverQualityGateError", "EsgResearchBudgetExceededError", "HarnessBudgetExceededError"]
TRANSIENT_NAMES = ["APIConnectionError", "APIConnectionTimeoutError", "APITimeoutError", "InternalServerError", "RateLimitError", "TimeoutError"]
TRANSIENT_CODES = ["EAI_AGAIN", "ECONNREFUSED", "ECONNRESET", "ENETDOWN", "ENETUNREACH", "ENOTFOUND", "EPIPE", "ETIMEDOUT"]
TRANSIENT_WORDS = [
    "connection error", "connection refused", "connection reset", "connection timed out", "eai_again", "econnrefused", "econnreset", "enetunreach", "enotfound", "epipe", "etimedout",
    "fetch failed", "gateway timeout", "network error", "rate limited", "rate limit", "request timed out", "service unavailable", "socket hang up", "temporarily unavailable", "too many requests",
]


def transient(chain: Column) -> Column:
    """Whether another try may help, from an error and its causes (array of struct name, status, code, message).

    Eight links count. A terminal name anywhere ends the run; otherwise a status, name, code or
    phrase of any link has to say that the failure is passing. Unknown errors and null are not.
    """
    links = F.slice(F.coalesce(chain, F.array().cast("array<struct<name:string,status:string,code:string,message:string>>")), 1, 8)
    status = lambda e: F.when(e["status"].rlike(r"^\d{3}$"), e["status"].cast("int"))
    words = r"(?i)\b(?:" + "|".join(TRANSIENT_WORDS) + r")\b"
    passing = lambda e: F.coalesce(status(e).isin(408, 409, 425, 429) | status(e).between(500, 599), F.lit(False)) | F.coalesce(e["name"].isin(TRANSIENT_NAMES), F.lit(False)) | F.coalesce(F.upper(e["code"]).isin(TRANSIENT_CODES), F.lit(False)) | F.coalesce(e["message"].rlike(words), F.lit(False))
    return ~F.exists(links, lambda e: F.coalesce(e["name"].isin(TERMINAL_NAMES), F.lit(False))) & F.exists(links, passing)


def token(text: Column) -> Column:
    """FNV-1a of the text's UTF-16 units in 32 bits, in base 36."""
    start = F.lit(2166136261).cast("long")
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    codes = F.transform(units, lambda c: F.conv(c, 16, 10).cast("long"))
    mixed = F.aggregate(codes, start, lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), F.lit(1 << 32)))
    return F.lower(F.conv(mixed.cast("string"), 10, 36))


def positive_id(text: Column) -> Column:
    """A whole number above 0 from text; null for anything else."""
    n = F.when(F.trim(text).rlike(r"^\d{1,15}$"), F.trim(text)).try_cast("long")
    return F.when(n > 0, n)


def is_uuid(text: Column) -> Column:
    return text.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def split_list(text: Column, separators: str = "[;,|]") -> Column:
    """Trimmed parts, without empty ones, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separators), lambda x: F.trim(x)), lambda x: x != ""))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced, spaces collapsed."""
    out = reduce(lambda t, item: F.replace(t, F.lit("{" + item[0] + "}"), F.coalesce(item[1], F.lit(""))), values.items(), F.lit(template))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, rounded down; 0 of nothing."""
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(F.lit(0)).cast("int")


def minutes_left(seconds: Column) -> Column:
    return F.concat(F.ceil(seconds / 60).cast("string"), F.when(F.ceil(seconds / 60) == 1, " minute").otherwise(" minutes"))


def day_range(start: Column, end: Column) -> Column:
    """One day (the one that is there, if only one is), days of a month, or two dates."""
    day = lambda c, f: F.date_format(c, f)
    same_month = F.date_trunc("month", start) == F.date_trunc("month", end)
    return (
        F.when(start.isNull() | end.isNull() | (start == end), day(F.coalesce(start, end), "d MMM yyyy"))
        .when(same_month, F.concat(day(start, "d"), F.lit("-"), day(end, "d MMM yyyy")))
        .otherwise(F.concat(day(start, "d MMM yyyy"), F.lit(" - "), day(end, "d MMM yyyy")))
    )
