"""Claims against the evidence that they cite: hard claims, rules of a draft, combined verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog, metrics, text
from tessera.functions.evidence import TARGET, verdict_issues

#: Reasons of each kind that a verdict keeps. Fixed value.
MOST_REASONS = 8
#: Words of a hard claim that are no subject. Fixed values.
NO_SUBJECT = (
    "align aligned alignment companies company compliance comply country disclose disclosure disclosures driver guidance mandatory mandate mandated must "
    "organizations policy regulation report reporting required requirement requirements requires sector shall standard standards that their these this under with"
).split()
#: Countries whose mention marks a source as foreign. Fixed values.
KNOWN_COUNTRIES = ["nigeria", "egypt", "india", "china", "united states", "united kingdom", "saudi arabia", "united arab emirates", "kazakhstan"]
#: Phrases of the national target that has rules of its own. Fixed values.
NET_ZERO, ALIGNED = r"(?i)net[\s-]?zero\s+2050", r"(?i)\balign(?:ed|ment)?\b"
CLAIMED, RULED = r"(?i)\b(require|requires|required|must|mandated)\b", r"(?i)\b(require|requires|required|must|mandated|mandatory|regulation|rule)\b"
#: A quantity that needs a year. Fixed values.
_AMOUNT = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
QUANTITY = (
    rf"(?i)((?:US\$|USD|AED|SAR|EUR|GBP|\$|€|£)\s?{_AMOUNT}(?:\s?(?:thousand|million|billion|trillion|k|mn|bn|tn))?"
    rf"|\b{_AMOUNT}\s?(?:%|percent(?:age)?(?:\s+points?)?)"
    rf"|\b{_AMOUNT}\s?(?:thousand|million|billion|trillion|k|mn|bn|tn|kg|kt|mt|gt|kw|mw|gw|twh|mwh|kwh|gwh|tonnes?|tons?|tco2e?|mtco2e?|gtco2e?|co2e?|°c|degrees?\s+celsius|basis\s+points?|bps)\b)"
)


def passages(body: Column) -> Column:
    """Parts between sentence ends, semicolons and newlines, trimmed, without empty ones."""
    trimmed = F.transform(F.split(body, r"[.!?;\n]+"), lambda x: F.regexp_replace(x, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def mentions(words: Column, aliases: Column) -> Column:
    """Whether an alias stands in ``words``, a text in the form of text.words_form()."""
    return F.exists(aliases, lambda a: (a != "") & F.concat(F.lit(" "), words, F.lit(" ")).contains(F.concat(F.lit(" "), a, F.lit(" "))))


def _required(conditions: dict[str, Column] | Sequence[tuple[Column, Column]]) -> Column:
    """The messages whose conditions hold, in order; an unknown condition does not hold."""
    return F.filter(F.array(*(F.when(test, message) for message, test in conditions)), lambda x: x.isNotNull())


def hard_claim_support(drivers: DataFrame, sources: DataFrame) -> DataFrame:
    """driver_id, n_claims, n_unsupported: a driver's passages with hard wording, and those no source bears out.

    ``drivers`` has driver_id, texts (array), and country_aliases and sector_aliases in
    text.words_form(). ``sources``, those that a driver cites: driver_id, source_id, content, direct.

    A claim holds if one passage of one direct source has obligation wording, names the country and
    the sector where the claim does, and has two of the claim's subject terms (one, if it has only
    one; a claim without any is not borne out). Passages are divided into words and meet on (driver,
    word), so a passage that shares no word with a claim is never paired with it. Every driver has a
    row; null texts and contents have no passages.
    """
    body = F.array_join(F.filter("texts", lambda x: x.isNotNull()), "\n")
    claims = drivers.select("driver_id", "country_aliases", "sector_aliases", F.posexplode(passages(body)).alias("claim", "passage")).filter(F.col("passage").rlike(catalog.HARD_CLAIM))
    words = text.words_form(F.col("passage"))
    scope = F.flatten(F.transform(F.concat("country_aliases", "sector_aliases"), lambda a: F.split(a, " ")))
    subjects = F.filter(F.array_distinct(F.split("words", " ")), lambda w: ((F.length(w) >= 4) | w.rlike(r"\d")) & ~w.isin(NO_SUBJECT))
    claims = claims.withColumn("words", words).withColumn("terms", F.array_except(subjects, scope))
    claims = claims.select("driver_id", "claim", "terms", mentions(F.col("words"), F.col("country_aliases")).alias("of_country"), mentions(F.col("words"), F.col("sector_aliases")).alias("of_sector"))
    claims = claims.withColumn("needed", F.least(F.lit(2), F.size("terms")))

    found = sources.filter("direct").select("driver_id", "source_id", F.posexplode(passages(F.col("content"))).alias("place", "passage")).filter(F.col("passage").rlike(catalog.OBLIGATION))
    found = found.withColumn("words", words).join(drivers.select("driver_id", "country_aliases", "sector_aliases"), "driver_id")
    found = found.select("driver_id", "source_id", "place", F.explode(F.array_distinct(F.split("words", " "))).alias("term"), mentions(F.col("words"), F.col("country_aliases")).alias("in_country"), mentions(F.col("words"), F.col("sector_aliases")).alias("in_sector"))

    asked = claims.select("driver_id", "claim", "needed", "of_country", "of_sector", F.explode("terms").alias("term"))
    met = asked.join(found, ["driver_id", "term"]).filter((~F.col("of_country") | F.col("in_country")) & (~F.col("of_sector") | F.col("in_sector")))
    held = met.groupBy("driver_id", "claim", "source_id", "place", "needed").count().filter("count >= needed").select("driver_id", "claim").distinct().withColumn("held", F.lit(True))
    counts = claims.select("driver_id", "claim").join(held, ["driver_id", "claim"], "left").groupBy("driver_id")
    counts = counts.agg(F.count("*").alias("n_claims"), F.count_if(F.col("held").isNull()).alias("n_unsupported"))
    zero = F.lit(0).cast("long")
    return drivers.select("driver_id").join(counts, "driver_id", "left").select("driver_id", F.coalesce("n_claims", zero).alias("n_claims"), F.coalesce("n_unsupported", zero).alias("n_unsupported"))


def undated_quantities(texts: Column) -> Column:
    """Quantities (the first spelling of each) that stand in no clause with a year."""
    clauses = F.flatten(F.transform(texts, lambda x: F.split(x, r"[;!?\n]+|\.(?=\s+[A-Z]|$)")))
    struct = lambda c: F.struct(F.regexp_extract_all(F.replace(c, F.lit("CO₂"), F.lit("CO2")), F.lit(QUANTITY), F.lit(1)).alias("found"), c.rlike(r"\b(?:19|20)\d{2}\b").alias("dated"))
    listed = F.transform(clauses, struct)
    plain = lambda q: F.lower(F.regexp_replace(q, r"[\s,]+", ""))
    dated = F.transform(F.flatten(F.transform(F.filter(listed, lambda s: s.dated), lambda s: s.found)), plain)
    open_ = F.filter(F.flatten(F.transform(listed, lambda s: s.found)), lambda q: ~F.array_contains(dated, plain(q)))
    empty = F.array().cast("array<string>")
    return F.aggregate(open_, empty, lambda seen, q: F.when(F.exists(seen, lambda s: plain(s) == plain(q)), seen).otherwise(F.array_append(seen, F.trim(q))))


def verify(drivers: DataFrame, evidence: DataFrame) -> DataFrame:
    """A verdict on every driver: driver_id, passed, score, recommended, reasons, repairs, metrics, source_issues, style_issues, can_repair.

    ``drivers``: driver_id, logic_id, section, type and what they were assigned (assigned_...),
    title, body, relevance, indicator, confidence, source_links and source_refs (arrays), country,
    sector. ``evidence``, the pack of each driver: driver_id, ordinal, source_id, url, title, domain,
    content, approval_id, usage, status, provenance, authority, country_scope and sector_scope
    (arrays). Of rows with one url the last counts.

    Each rule adds a reason of its kind; 100 less 10 a reason, less what confidence lacks of TARGET, is
    the score. Null texts are empty, null lists have no items, a null confidence is 0, null flags of
    evidence speak against it. Drivers without evidence have a verdict too.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    texts = F.array(*(blank(c) for c in ("title", "body", "relevance", "indicator")))
    drivers = drivers.withColumns({"texts": texts, "country_aliases": catalog.country_aliases(F.col("country")), "sector_aliases": catalog.sector_aliases(F.col("sector")), "source_links": none("source_links"), "source_refs": none("source_refs"), "confidence": F.coalesce("confidence", F.lit(0))})
    scope = drivers.select("driver_id", "country", "sector", "type", "logic_id", "assigned_type", "assigned_logic_id")

    direct = (F.col("approval_id").isNotNull() & (F.col("approval_id") != "") & (F.col("usage") == "direct") & (F.col("status") == "retrieved") & (F.col("provenance") == "retrieved-page") & (F.trim(blank("content")) != ""))
    pack = evidence.groupBy("driver_id", "url").agg(F.max_by(F.struct(*(c for c in evidence.columns if c not in ("driver_id", "url"))), "ordinal").alias("s")).select("driver_id", "url", "s.*")
    pack = pack.withColumn("direct", F.coalesce(direct, F.lit(False))).withColumn("strong", F.coalesce(F.col("direct") & (F.col("authority") >= TARGET), F.lit(False)))
    links = drivers.select("driver_id", F.posexplode("source_links").alias("link", "url"))
    linked = links.join(pack, ["driver_id", "url"])

    approval = F.lower(F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "url", "domain", "content"))))
    cited = linked.join(scope.withColumnRenamed("type", "_t").drop("logic_id", "_t"), "driver_id").withColumn("words", text.words_form(approval))
    in_country, in_sector = mentions(F.col("words"), catalog.country_aliases(F.col("country"), False)), mentions(F.col("words"), catalog.registry_sector_aliases(F.col("sector")))
    of_country = F.col("assigned_type") == "Country-related"
    of_sector = (F.col("assigned_type") == "Sector-related") | F.col("assigned_logic_id").contains("sector") | F.col("assigned_logic_id").contains("supply-chain")
    foreign = ~in_country & mentions(F.col("words"), F.array(*map(F.lit, KNOWN_COUNTRIES)))
    named = lambda *parts: F.concat(F.lit("linked source "), F.col("source_id"), *parts)
    misfits = _required([
        (named(F.lit(" does not support "), "country", F.lit(" relevance")), of_country & ~in_country & ~F.array_contains(none("country_scope"), "Global")),
        (named(F.lit(" appears country-mismatched")), of_country & foreign),
        (named(F.lit(" does not support "), "sector", F.lit(" relevance")), of_sector & ~in_sector & ~F.array_contains(none("sector_scope"), "All") & ~F.exists(none("sector_scope"), lambda s: s != "general")),
    ])
    zero_2050 = F.col("approval").rlike(NET_ZERO) & in_sector
    some = cited.withColumn("approval", approval).groupBy("driver_id").agg(
        F.count("*").alias("n_linked"), F.bool_or("strong").alias("strong"), F.array_sort(F.collect_set("source_id")).alias("ids"),
        F.bool_or(F.coalesce(F.col("approval_id"), F.lit("")) == "").alias("unapproved"), F.bool_or(F.coalesce(F.col("usage") != "direct", F.lit(True))).alias("context"), F.bool_or(~F.col("direct")).alias("unread"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("link", misfits.alias("m")))), lambda x: x.m))).alias("misfits"),
        F.array_join(F.collect_list(F.when(F.col("direct"), F.col("content"))), " ").alias("proof"), F.bool_or(zero_2050).alias("zero_sector"), F.bool_or(zero_2050 & F.col("approval").rlike(RULED)).alias("zero_rule"),
    )
    pool = pack.groupBy("driver_id").agg(F.bool_or("strong").alias("pool_strong"), F.collect_set("url").alias("urls"))
    hard = hard_claim_support(drivers, linked.select("driver_id", "source_id", "content", "direct").distinct())

    full = drivers.join(some, "driver_id", "left").join(pool, "driver_id", "left").join(hard, "driver_id")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    claim = F.array_join("texts", " ")
    lacking = metrics.grounding(metrics.metrics(claim), metrics.metrics(blank("proof"))).getField("unsupported")
    full = full.withColumns({"n_linked": F.coalesce("n_linked", F.lit(0).cast("long")), "lacking": lacking, "undated": undated_quantities(F.col("texts")), "claim": claim, "words": text.words_form(F.concat_ws(" ", blank("title"), blank("body"), blank("relevance")))})
    n_links, weak = F.size("source_links"), (F.col("n_linked") > 0) & ~yes("strong")
    zero = F.col("claim").rlike(NET_ZERO)
    is_hard = F.col("claim").rlike(catalog.HARD_CLAIM)
    count = text.word_count(F.col("body"))
    message = F.lit
    repairs = _required([
        (message("driver logic id does not match assigned logic"), ~F.col("logic_id").eqNullSafe(F.col("assigned_logic_id"))),
        (message("driver section or type does not match assigned logic"), ~F.col("section").eqNullSafe(F.col("assigned_section")) | ~F.col("type").eqNullSafe(F.col("assigned_type"))),
        (F.concat(message("every quantitative metric must state its evidence year; missing metric year for "), F.array_join("undated", ", ")), F.size("undated") > 0),
        (message("country/sector relevance is not explicit enough"), ~mentions(F.col("words"), F.col("country_aliases")) | ~mentions(F.col("words"), F.col("sector_aliases"))),
    ])
    about_links = _required([
        (message("driver must cite 1 to 3 source links"), ~n_links.between(1, 3)),
        (message("one or more source links are outside the evidence pack"), F.size(F.array_except("source_links", none("urls"))) > 0),
        (message("source links must be unique"), F.size(F.array_distinct("source_links")) != n_links),
        (message("no linked source could be matched to parsed evidence"), F.col("n_linked") == 0),
        (message("one or more linked sources are not approved driver sources"), yes("unapproved")),
        (message("context-only source cited as direct evidence"), yes("context")),
        (message("one or more citations lack retrieved-page direct evidence"), yes("unread")),
        (message("source references do not exactly match the cited source links"), F.array_sort(F.array_distinct("source_refs")) != none("ids")),
    ])
    about_rank = _required([
        (message(f"cited source authority is below the required {TARGET}; cite a stronger approved source from the evidence pack"), weak & yes("pool_strong")),
        (message(f"approved evidence has no direct source meeting the required authority score of {TARGET}"), weak & ~yes("pool_strong")),
    ])
    about_claims = _required([
        (message("hard obligation or alignment wording lacks obligation language and matching scope/subject in one linked evidence passage"), F.col("n_unsupported") > 0),
        (F.concat(message("national net-zero alignment claim is not directly linked to "), "sector", message(" in one cited evidence source")), is_hard & zero & F.col("claim").rlike(ALIGNED) & ~yes("zero_sector")),
        (F.concat(message("national net-zero requirement claim is not directly linked to "), "sector", message(" in one cited evidence source")), is_hard & zero & F.col("claim").rlike(CLAIMED) & ~yes("zero_rule")),
    ])
    style = _required([
        (message("title is too generic"), F.trim(blank("title")).rlike(catalog.WEAK_TITLE)),
        (message("driver text should be one compact 20 to 50 word paragraph"), ~count.between(15, 60)),
    ])
    kinds = {"repairs": repairs, "source_issues": F.concat(about_links, none("misfits"), about_rank, about_claims), "metrics": F.transform("lacking", lambda m: F.concat(message("Metric not found in linked evidence: "), m)), "style_issues": style}
    judged = full.withColumns(kinds).withColumn("reasons", F.concat("repairs", "source_issues", "metrics", "style_issues"))
    score = F.greatest(F.lit(0), 100 - F.size("reasons") * 10 - F.greatest(F.lit(0), TARGET - F.col("confidence")))
    judged = judged.withColumn("score", score.cast("int"))
    judged = judged.withColumn("recommended", F.greatest(F.lit(35), F.least("confidence", "score", F.when(F.col("n_linked") > 0, 96).otherwise(60))).cast("int"))
    judged = judged.withColumn("gate", verdict_issues(F.col("score"), F.col("recommended")))
    cut = lambda c: F.slice(text.unique_strings(c), 1, MOST_REASONS)
    return judged.select(
        "driver_id", (F.size(F.concat("reasons", "gate")) == 0).alias("passed"), "score", "recommended", cut(F.concat("reasons", "gate")).alias("reasons"), cut(F.concat("repairs", "gate")).alias("repairs"),
        cut(F.col("metrics")).alias("metrics"), cut(F.col("source_issues")).alias("source_issues"), cut(F.col("style_issues")).alias("style_issues"), (~weak | yes("pool_strong")).alias("can_repair"),
    )


#: The typed lists of a verdict.
KINDS = ("repairs", "metrics", "source_issues", "style_issues")


def combined(local: Column, model: Column) -> Column:
    """One verdict (struct as verify() gives it) of the rules' and a model's.

    A model's typed issues block, and so does a negative word of it, with its reasons or a standing
    one. Score and confidence are the rules' unless the model blocks; then the lesser ones count. A
    null verdict of the model blocks as a negative one without words.
    """
    cut = lambda c: F.slice(text.unique_strings(c), 1, MOST_REASONS)
    none = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    said = {k: text.unique_strings(none(model[k])) for k in KINDS}
    why = text.unique_strings(none(model["reasons"]))
    positive = F.coalesce(model["passed"], F.lit(False))
    standing = F.array(F.lit("semantic verifier rejected the driver"))
    refused = F.when(positive, F.array().cast("array<string>")).when(F.size(why) > 0, why).otherwise(standing)
    blocking = text.unique_strings(F.concat(refused, *(said[k] for k in KINDS)))
    open_ = positive & (F.size(blocking) == 0)
    least = lambda name: F.when(open_, local[name]).otherwise(F.least(local[name], F.coalesce(model[name], F.lit(0))))
    score, sure = least("score"), least("recommended")
    passed = local["passed"] & open_ & (score >= TARGET) & (sure >= TARGET)
    gate = F.when(passed, F.array().cast("array<string>")).otherwise(verdict_issues(score, sure))
    joined = {k: cut(F.concat(local[k], said[k])) for k in KINDS}
    reasons = cut(F.concat(local["reasons"], blocking))
    can = F.when(open_, local["can_repair"]).otherwise(local["can_repair"] & F.coalesce(model["can_repair"], F.lit(False)))
    return F.struct(
        passed.alias("passed"), score.alias("score"), sure.alias("recommended"), cut(F.concat(reasons, gate)).alias("reasons"), cut(F.concat(joined["repairs"], gate)).alias("repairs"),
        *(joined[k].alias(k) for k in KINDS[1:]), can.alias("can_repair"),
    )


#: What makes an indicator specific, and words of projections, in a review of accuracy. Fixed values.
SPECIFIC_EVIDENCE = r"(?i)\d|%|co2|co₂|scope|ifrs|issb|gri|ndc|net zero|cbam|2030|2040|2050"
PROJECTION = r"(?i)\b(projected|expected|survey|studies indicate|could lead|could result|market is)\b"
#: Labels that name no source. Fixed values.
GENERIC_LABEL = r"(?i)^(source\s*\d*|regulatory body|industry body|industry report|consulting firm)$|research firm"


def accuracy_review(drivers: DataFrame, sources: DataFrame) -> DataFrame:
    """driver_id, level (``strong``, ``checked``, ``limited``), reasons: how far a finished driver can be relied on.

    ``drivers``: driver_id, warnings and key_sources (arrays), indicator, confidence; ``sources``: driver_id,
    authority, score of those that it cites. Null lists have no items, null marks are 0, a null indicator is empty.
    """
    none = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    mark = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = sources.groupBy("driver_id").agg(F.count("*").alias("n"), F.max(mark("authority")).alias("best"), F.bool_and((mark("authority") < 60) & (mark("score") < 60)).alias("weak"))
    rows = drivers.join(own, "driver_id", "left")
    n, sure, said = mark("n"), mark("confidence"), F.coalesce("indicator", F.lit(""))
    generic = F.exists(none("key_sources"), lambda k: F.coalesce(F.trim(k).rlike(GENERIC_LABEL), F.lit(False)))
    broad = said.rlike(PROJECTION) & (F.coalesce("best", F.lit(0)) < 70)
    found = _required([
        (F.lit("no parsed source detail"), n == 0), (F.lit("generic source label"), generic), (F.lit("evidence/KPI is not specific"), ~said.rlike(SPECIFIC_EVIDENCE)), (F.lit("projection needs direct citation"), broad),
        (F.concat(F.lit("confidence "), sure.cast("string")), sure < 70), (F.lit("weak source mix"), F.coalesce("weak", F.lit(False))),
    ])
    reasons = text.unique_strings(F.concat(none("warnings"), found))
    rows = rows.withColumns({"reasons": reasons, "_limited": (sure < 70) | generic | broad})
    level = F.when((sure >= 80) & (F.size("reasons") == 0), "strong").when(F.col("_limited") | (F.size("reasons") >= 2), "limited").otherwise("checked")
    rows = rows.withColumn("level", level)
    standing = F.when(F.col("level") == "limited", F.array(F.lit("source support is limited"))).when(F.col("level") == "checked", F.array(F.lit("moderate confidence"))).otherwise(F.col("reasons"))
    return rows.select("driver_id", "level", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(standing).alias("reasons"))
