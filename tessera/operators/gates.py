"""Gates that a found source passes before it counts as evidence: scope, retrieval, freshness, publisher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import catalog, text
from tessera.functions.text import phrase_form
from tessera.operators.collection import concept_issue
from tessera.operators.registry import is_approved, suffixes

#: Relevance that a page loses whose words miss the concept or the claims. Fixed value.
CONCEPT_PENALTY = 25
#: What shows that a page, or a standard, is in force. Fixed values.
IN_FORCE = r"\b(currently effective|currently in force|remains in force|effective as of|in force|current policy|current regulation|latest update)\b"
LATEST = r"\b(latest (?:active |current )?version|current active version|currently effective standard|latest standard|current version|supersedes? version)\b"
#: Years after which a category's pages are old, least and most of any. Fixed values.
AGES, OLD, LEAST_AGE, MOST_AGE = {"forecast": 3, "market-metric": 3}, 5, 0.25, 20
#: Groups of sectors as registries name them, and families of sectors. Fixed values.
SECTOR_GROUPS = {"banking": "Banking", "construction": "Construction", "real-estate": "Real Estate", "oil-gas": "Oil & Gas"}
FAMILIES = {"banking": "Financial Services", "construction": "Built Environment", "real-estate": "Built Environment", "oil-gas": "Energy"}


def freshness(category: Column, date: Column, base: Column, max_age: Column, version: Column, said: Column, today: Column) -> Column:
    """struct(accepted, score, reason): whether a page is fresh enough for its category, and what its freshness is worth.

    ``date`` is the page's best date (null if unknown), ``base`` the score that goes with it, ``max_age`` in
    years (null or 0 for the category's own), ``version`` that of the reviewed document, ``said`` the page's
    text. A page that fails keeps a reduced score: it ranks lower, it doesn't go.
    """
    low = F.lower(text.collapse(F.coalesce(said, F.lit(""))))
    own = F.coalesce(*(F.when(category == k, F.lit(v)) for k, v in AGES.items()), F.lit(OLD))
    age = F.greatest(F.lit(LEAST_AGE), F.least(F.lit(float(MOST_AGE)), F.coalesce(F.nullif(max_age.cast("double"), F.lit(0.0)), own.cast("double"))))
    seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
    recent = F.coalesce(seconds(date) >= seconds(today) - age * (365.25 * 24 * 60 * 60), F.lit(False))
    wanted = F.nullif(F.trim(version), F.lit(""))
    quoted = F.regexp_replace(wanted, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    has_version = F.coalesce(F.rlike(low, F.concat(F.lit(r"(?i)\b(?:version\s*|v\s*)"), quoted, F.lit(r"\b"))), F.lit(False))
    years = F.transform(F.regexp_extract_all(low, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    measured = F.array_max(F.filter(years, lambda y: (y >= 1990) & (y <= F.year(today))))
    metric_recent = F.coalesce(measured >= F.year(today) - F.ceil(age), F.lit(False))

    out = lambda ok, score, why: F.struct(F.lit(ok).alias("accepted"), score.cast("int").alias("score"), why.cast("string").alias("reason"))
    none = F.lit(None)
    at_least = lambda n: out(True, F.when(recent, base).otherwise(F.greatest(base, F.lit(n))), none)
    at_most = lambda n, why: out(False, F.least(base, F.lit(n)), why)
    lacks = F.concat(F.lit("Standard source does not contain reviewed document version "), wanted, F.lit("."))
    standard = (
        F.when(wanted.isNotNull() & ~has_version, at_most(40, lacks))
        .when(wanted.isNull() & ~low.rlike(LATEST), at_most(40, F.lit("Standard source does not establish that it is the publisher's latest active version.")))
        .otherwise(at_least(55))
    )
    rule = F.when(~recent & ~low.rlike(IN_FORCE), at_most(35, F.concat(category, F.lit(" source is neither recent nor explicitly shown as currently effective.")))).otherwise(at_least(55))
    market = category == "market-metric"
    old = F.when(market, "Market metric has no recent publication date or independently retrieved metric year.").otherwise("Forecast source is outside the accepted freshness window.")
    other = F.when(~recent & ~(market & metric_recent), at_most(35, old)).otherwise(at_least(60))
    return F.when(category == "evergreen", out(True, base, none)).when(category == "standard", standard).when(category.isin("regulation", "policy"), rule).otherwise(other)


def sector_group(sector: Column) -> Column:
    """The registry's name of a sector's group; ``general`` for one that no word places."""
    low = F.lower(sector)
    return F.coalesce(*(F.when(low.rlike(catalog.SECTORS[name]), F.lit(group)) for group, name in SECTOR_GROUPS.items()), F.lit("general"))


def canonical_country(country: Column) -> Column:
    low = F.lower(F.trim(country))
    return (
        F.when((low == "uae") | low.contains("united arab emirates"), "uae").when(low.contains("saudi"), "saudi-arabia").when(low.contains("kazakhstan"), "kazakhstan").otherwise(F.regexp_replace(low, "[^a-z0-9]+", "-"))
    )


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def scope_reason(record: Column, country: Column, sector: Column, logic: Column) -> Column:
    """Why a record's scope rules a request out before any page is read: ``not-approved``, ``logic-``, ``country-`` or ``sector-mismatch``; null if it doesn't."""
    in_country = _no(F.array_contains(record["countries"], "Global")) | _no(F.exists(record["countries"], lambda c: canonical_country(c) == canonical_country(country)))
    in_sector = _no(F.array_contains(record["sectors"], "All")) | _no(F.array_contains(record["sectors"], sector_group(sector)))
    return F.when(record["record_id"].isNull(), "not-approved").when(~is_approved(record, logic), "logic-mismatch").when(~in_country, "country-mismatch").when(~in_sector, "sector-mismatch")


def approval_reason(record: Column, source: Column, country: Column, sector: Column, logic: Column) -> Column:
    """Why a retrieved source is no evidence, the first of ``not-approved``, ``retrieval-failed``, ``logic-``, ``country-`` and ``sector-mismatch``; null if it is.

    ``record``: record_id, usage, logic_ids, sections, countries, sectors, needs_country, needs_sector;
    ``source``: title, url, domain, content, snippet, status, provenance, contextual; ``logic``: logic_id,
    type, section, catalog, registry_ids, country_scopes, sector_scopes, families. A reviewed context source
    that could not be read passes with its snippet.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    context = _no(source["contextual"]) & _no(source["provenance"] == "approved-context")
    fallback = _no(record["usage"] == "context") & context
    read = _no(source["status"] == "retrieved") & _no(source["provenance"] == "retrieved-page") & (F.trim(blank(source["content"])) != "")
    snippet = F.when(context, source["snippet"])
    whole = F.concat_ws(" ", *(F.nullif(source[c], F.lit("")) for c in ("title", "url", "domain", "content")), F.nullif(snippet, F.lit("")))
    has = lambda body, aliases: F.exists(aliases, lambda a: phrase_form(body).contains(F.concat(F.lit(" "), a, F.lit(" "))))
    own_country = _no(F.exists(logic["country_scopes"], lambda s: canonical_country(s) == canonical_country(country))) & ~_no(F.array_contains(logic["country_scopes"], "All"))
    needs_country = _no(record["needs_country"]) | _no(logic["type"] == "Country-related") | own_country
    no_country = needs_country & ~has(whole, catalog.country_aliases(country, False))
    scopes = F.coalesce(logic["sector_scopes"], F.array().cast("array<string>"))
    group = sector_group(sector)
    family = F.coalesce(*(F.when(group == g, F.lit(f)) for g, f in FAMILIES.items()), F.lit("Other"))
    by_scope = (F.size(scopes) > 0) & ~F.array_contains(scopes, "All") & (F.exists(scopes, lambda s: sector_group(s) == group) | _no(F.array_contains(logic["families"], family)))
    needs_sector = _no(record["needs_sector"]) | _no(logic["type"] == "Sector-related") | _no(logic["logic_id"].contains("sector")) | _no(logic["logic_id"].contains("supply-chain")) | by_scope
    body = F.concat_ws(" ", source["content"], F.coalesce(snippet, F.lit("")))
    no_sector = needs_sector & ~has(body, catalog.registry_sector_aliases(sector)) & ~_no(F.array_contains(record["sectors"], group))
    scope = scope_reason(record, country, sector, logic)
    return (
        F.when(scope == "not-approved", scope).when(~read & ~fallback, "retrieval-failed").when(scope.isin("logic-mismatch", "country-mismatch"), scope).when(~fallback & no_country, "country-mismatch")
        .when(scope == "sector-mismatch", scope).when(~fallback & no_sector, "sector-mismatch")
    )


def relevance_after(relevance: Column, page: Column, concept: Column, claims: Column, catalog_logic: Column) -> Column:
    """A source's relevance, less CONCEPT_PENALTY if a logic of the catalog finds neither concept nor claim in it; not below 0."""
    misses = _no(catalog_logic) & concept_issue(page, concept, claims).isNotNull()
    return F.greatest(F.lit(0), relevance - F.when(misses, CONCEPT_PENALTY).otherwise(0))


def gate_any(judged: DataFrame, source: str = "source_id", ordinal: str = "ordinal") -> DataFrame:
    """One row a source: that of the first logic (by ordinal) that approves it (``reason`` is null), else the first rejection."""
    best = F.min_by(F.struct(*judged.columns), F.struct(F.col("reason").isNotNull(), F.col(ordinal)))
    return judged.groupBy(source).agg(best.alias("_s")).select("_s.*")


def publisher_class(hosts: DataFrame, direct: DataFrame, guidance: DataFrame) -> DataFrame:
    """host, class of each distinct host: ``direct-publisher``, ``guidance-only`` or ``unreviewed``, by reviewed domains (domain) at or above it."""
    known = hosts.select("host").filter("host is not null").distinct()
    bare = lambda df: df.select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("domain")).distinct()
    listed = bare(direct).withColumn("_rank", F.lit(0)).unionByName(bare(guidance).withColumn("_rank", F.lit(1)))
    own = F.regexp_replace(F.lower(F.trim("host")), r"^www\.", "")
    met = known.select("host", F.explode(suffixes(own)).alias("domain")).join(listed, "domain").groupBy("host").agg(F.min("_rank").alias("_rank"))
    name = F.when(F.col("_rank") == 0, "direct-publisher").when(F.col("_rank") == 1, "guidance-only").otherwise("unreviewed")
    return known.join(met, "host", "left").select("host", name.alias("class"))
