"""Freshness, approval and publisher gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import urls
from tessera.operators import gates
from tessera.plans.registry import Tables, query

_CATEGORIES = ["evergreen", "standard", "regulation", "policy", "forecast", "market-metric"]
_SAID = ["", "The rule is in  force.", "latest version", "Version 2.0 of 1998", "see V 2.0", "version 2.01", "measured in 1997 and 2050", "measured in 1985", None]


def _at(values: list, k: Column) -> Column:
    return F.array(*(F.lit(v) for v in values))[(k % len(values)).cast("int")]


@query(f"""
    with r as (
      select o_orderkey as id, ({_CATEGORIES})[o_orderkey % 6 + 1] as category, case when o_orderkey % 7 > 0 then o_orderdate end as day, (o_orderkey % 61 + 20)::int as base, ([null, 0, 2, 0.1, 50])[o_orderkey % 5 + 1]::double as given, (o_orderkey % 9)::int as t,
             case when o_orderkey % 4 = 1 then '2.0' when o_orderkey % 4 = 2 then '(1+)' end as version from orders),
    a as (select *, greatest(0.25, least(20, coalesce(nullif(given, 0), case when category in ('forecast', 'market-metric') then 3 else 5 end)))::double as age, case t when 3 then 1998 when 6 then 1997 end as measured from r),
    f as (select *, coalesce(epoch(day) >= epoch(timestamp '1999-06-01') - age * 365.25 * 86400, false) as recent from a),
    g as (
      select *, case when category = 'evergreen' then true when category = 'standard' then case when version is not null then version = '2.0' and t in (3, 4) else t = 2 end when category in ('regulation', 'policy') then recent or t = 1
                     else recent or (category = 'market-metric' and coalesce(measured >= 1999 - ceil(age), false)) end as ok from f)
    select id, ok as accepted, case when category = 'evergreen' then base when ok then case when recent then base else greatest(base, case when category in ('forecast', 'market-metric') then 60 else 55 end) end when category = 'standard' then least(base, 40) else least(base, 35) end::int as score,
           case when ok then null when category = 'standard' and version is not null then 'Standard source does not contain reviewed document version ' || version || '.' when category = 'standard' then 'Standard source does not establish that it is the publisher''s latest active version.'
                when category in ('regulation', 'policy') then category || ' source is neither recent nor explicitly shown as currently effective.' when category = 'market-metric' then 'Market metric has no recent publication date or independently retrieved metric year.'
                else 'Forecast source is outside the accepted freshness window.' end as reason from g""")
def freshness_gate(t: Tables) -> DataFrame:
    """Sources of six categories against the age, version and wording that each asks for."""
    k = F.col("o_orderkey")
    given = F.when(k % 5 == 1, 0.0).when(k % 5 == 2, 2.0).when(k % 5 == 3, 0.1).when(k % 5 == 4, 50.0)
    version = F.when(k % 4 == 1, "2.0").when(k % 4 == 2, "(1+)")
    verdict = gates.freshness(_at(_CATEGORIES, k), F.when(k % 7 > 0, F.col("o_orderdate")), (k % 61 + 20).cast("int"), given, version, _at(_SAID, k), F.expr("timestamp_ntz '1999-06-01 00:00:00'"))
    return t.orders.select(k.alias("id"), verdict.alias("v")).select("id", "v.*")


_CONTENTS = ["UAE banks lend", "Kazakhstan oil", "An Emirati plan", "nothing", "Lenders in the U.A.E. and UAE", " ", "UAE", "UAE", "UAE"]
_JUDGED_SQL = """
    p as (select page_id as id, page_id % 11 > 0 as known, page_id % 4 < 2 as in_country, page_id % 6 < 4 as in_sector, page_id % 6 in (2, 3) as for_banks, page_id % 7 > 0 and page_id % 10 > 0 and page_id % 9 <> 5 as read, page_id % 10 = 0 as fallback,
                 page_id % 5 = 0 and page_id % 3 = 0 as off_catalog, page_id % 9 in (0, 2, 4, 6, 7, 8) as names_country, page_id % 9 in (0, 4) as names_sector from pages),
    judged as (
      select id, n as ordinal, case when not known then 'not-approved' when not read and not fallback then 'retrieval-failed' when n = 2 and off_catalog then 'logic-mismatch' when not in_country then 'country-mismatch' when not fallback and n = 1 and not names_country then 'country-mismatch'
             when not in_sector then 'sector-mismatch' when not fallback and n = 2 and not names_sector and not for_banks then 'sector-mismatch' end as reason,
             case when not known then 'not-approved' when n = 2 and off_catalog then 'logic-mismatch' when not in_country then 'country-mismatch' when not in_sector then 'sector-mismatch' end as preflight from p, (values (1), (2)) v(n))"""


def _named(**columns: Column) -> Column:
    return F.named_struct(*(part for name, column in columns.items() for part in (F.lit(name), column)))


def _judged(t: Tables) -> DataFrame:
    """Each page with two logics and the reasons that rule it out for them."""
    k = F.col("page_id")
    record = _named(
        record_id=F.when(k % 11 > 0, F.lit("r")), usage=F.when(k % 5 == 0, "context").otherwise("direct"), logic_ids=F.when(k % 3 == 0, F.array(F.lit("l0"))), sections=F.lit(None).cast("array<string>"),
        countries=F.array(_at(["Global", "united arab emirates", "Kazakhstan", "saudi"], k)), sectors=F.array(F.when(k % 6 < 2, "All").when(k % 6 < 4, "banking").otherwise("oil-gas")), needs_country=F.lit(False), needs_sector=F.lit(None).cast("boolean"),
    )
    source = _named(
        title=F.lit("T"), url=F.col("url"), domain=F.lit(None).cast("string"), content=_at(_CONTENTS, k), snippet=F.lit("UAE banks"), status=F.when(k % 7 > 0, "retrieved"),
        provenance=F.when(k % 10 == 0, "approved-context").otherwise("retrieved-page"), contextual=k % 10 == 0,
    )
    no = F.lit(None).cast("array<string>")
    of = lambda n, name, kind, in_catalog, countries, sectors: _named(
        ordinal=F.lit(n), logic_id=F.lit(name), type=F.lit(kind), section=F.lit(None).cast("string"), catalog=F.lit(in_catalog), registry_ids=no, country_scopes=countries, sector_scopes=sectors, families=no
    )
    logics = F.array(of(1, "l0", "Country-related", False, no, no), of(2, "l9", "General", True, F.array(F.lit("All")), F.array(F.lit("Banking"))))
    rows = t.pages.select(k.alias("source_id"), record.alias("record"), source.alias("source"), F.explode(logics).alias("logic"))
    uae, banking = F.lit("UAE"), F.lit("Banking")
    why = gates.approval_reason(F.col("record"), F.col("source"), uae, banking, F.col("logic"))
    return rows.select("source_id", "logic.ordinal", why.alias("reason"), gates.scope_reason(F.col("record"), uae, banking, F.col("logic")).alias("preflight"))


@query(f"with {_JUDGED_SQL} select id as source_id, ordinal, reason, preflight from judged")
def approval_gate(t: Tables) -> DataFrame:
    """Why each page is no evidence for each of two logics, before and after it is read."""
    return _judged(t)


@query(f"with {_JUDGED_SQL} select id as source_id, ordinal, reason from judged qualify row_number() over (partition by id order by reason is not null, ordinal) = 1")
def approval_by_any(t: Tables) -> DataFrame:
    """The first logic that takes each page, else the first rejection."""
    return gates.gate_any(_judged(t)).drop("preflight")


@query("""with h as (select distinct regexp_extract(lower(url), '^[a-z]+://(?:www[.])?([^/?#]+)', 1) as host from pages)
          select host, case when host = 'example.com' or ends_with(host, '.example.com') or host = 'blog.example.net' or starts_with(host, 'm.') and ends_with(host, 'x.org') then 'direct-publisher' when ends_with(host, '.net') or ends_with(host, '.example.com') then 'guidance-only' else 'unreviewed' end as class from h""")
def publisher_classes(t: Tables) -> DataFrame:
    """Whether the pages' hosts are reviewed publishers, guidance, or neither, by their domains."""
    listed = lambda *names: t.spark.createDataFrame([(n,) for n in names], "domain string")
    return gates.publisher_class(t.pages.select(urls.host(F.col("url")).alias("host")), listed("www.Example.com", "blog.example.net"), listed("net", "example.com"))
