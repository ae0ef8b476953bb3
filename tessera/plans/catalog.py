"""Normalised catalogs, claim language, small forms of dates and amounts, orders and JSON trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import catalog, evidence, metrics, variants
from tessera.functions.dates import previous_week
from tessera.operators import views
from tessera.plans.registry import Tables, query

_COUNTRIES = ["UAE; ksa", "Global", "and Kazakhstan,UZ, UZ,", "Qatar; sa", "", "Kingdom of Saudi-Arabia", "Republic of  Kazakhstan"]
_SECTORS = ["Retail banking; all sectors", "cement,Property and REIT", "Oil & gas; Power", "power and lng", "Trade & Retail", "Shipping", "", "insurance; Insurance; cross-sector"]
_SECTIONS = ["Global", " regulatory ", "CLIMATE RISK", "Capital Markets", "supply chain", "Other"]
_NAMES = ["Protocol for disclosure", "Carbon border law and standard", "Net zero roadmap", "Price outlook", "Green bond issuance", "Stranded assets", "Guidance notes", "Water", "Mandatory reporting shall begin", "Targets aligned with Paris", "ESG Compliance", "Sustainability trends "]
_URLS = ["u0.uae/a", "u1.kz/b", "u2.org", "", "u3.KZ/c", "u1.kz/b", "u4.net", "u5.net"]
_PERIODS = ["по декабрь 2027 г.", "Март 2025", "2026 г.", "по май", "с 01 ноября 2025 г."]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _pick(values: list[str], key: str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def _picked(values: list[str], key: str) -> str:
    return f"{_listed(values)}[{key} % {len(values)} + 1]"


def _case(text: str, spellings: dict[str, list[str]]) -> str:
    return "case " + " ".join(f"when {text} in ({', '.join(repr(v) for v in known)}) then '{name}'" for name, known in spellings.items()) + " end"


def _ladder(text: str, rules: dict[str, str], other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '{words}') then '{name}'" for name, words in rules.items()) + f" else {other} end"


_PARTS = r"list_filter(list_transform(string_split_regex({}, '[,;\n]+'), lambda x: regexp_replace(trim(x), '^and\s+', '', 'i')), lambda x: x <> '')"
_OIL = catalog.SCOPE_SECTORS[-1][2]
_RULES = [(s, f, f"regexp_matches(lower(x), '{w}')" + (f" and not regexp_matches(lower(x), '{catalog.POWER}')" if w == _OIL else "")) for s, f, w in catalog.SCOPE_SECTORS]
_SCOPE = "case " + " ".join(f"when {test} then '{s}'" for s, _, test in _RULES) + " else x end"
_FAMILY = "case " + " ".join(f"when {test} then '{f}'" for _, f, test in _RULES) + f" when regexp_matches(lower(x), '{catalog.OTHER_ENERGY}') then 'Energy' end"


@query(f"""with p as (select p_partkey as id, {_PARTS.format(_picked(_COUNTRIES, 'p_partkey'))} as c, {_PARTS.format(_picked(_SECTORS, 'p_partkey'))} as s from part),
          n as (select id, list_sort(list_distinct(list_transform(c, lambda x: coalesce({_case('lower(x)', catalog.SCOPE_COUNTRIES)}, x)))) as countries, list_sort(list_distinct(list_transform(s, lambda x: {_SCOPE}))) as sectors,
                list_sort(list_distinct(list_filter(list_transform(s, lambda x: {_FAMILY}), lambda x: x is not null))) as families from p)
          select id, coalesce(array_to_string(countries, '|'), '') as countries, coalesce(array_to_string(sectors, '|'), '') as sectors, case when len(families) = 0 then 'Other' else array_to_string(families, '|') end as families from n""")
def scope_lists(t: Tables) -> DataFrame:
    """Countries, sectors and sector families of free scope lists."""
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    countries, sectors = _pick(_COUNTRIES, "p_partkey"), _pick(_SECTORS, "p_partkey")
    return t.part.select(
        F.col("p_partkey").alias("id"), joined(catalog.scope_countries(countries)).alias("countries"),
        joined(catalog.scope_sectors(sectors)).alias("sectors"), joined(catalog.sector_families(sectors)).alias("families"),
    )


_FORM = r"trim(regexp_replace(replace(lower({}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""select p_partkey as id, {_case(_FORM.format(_picked(_COUNTRIES, 'p_partkey')), catalog.COUNTRIES)} as country, {_ladder(_FORM.format(_picked(_SECTORS, 'p_partkey')), catalog.SECTORS, 'null')} as sector,
          {_case(f"lower(trim({_picked(_SECTIONS, 'p_partkey')}))", catalog.SECTIONS)} as section from part""")
def canonical_scopes(t: Tables) -> DataFrame:
    """The supported country, sector and section of free text, null for others."""
    return t.part.select(
        F.col("p_partkey").alias("id"), catalog.country(_pick(_COUNTRIES, "p_partkey")).alias("country"),
        catalog.sector(_pick(_SECTORS, "p_partkey")).alias("sector"), catalog.spelled(_pick(_SECTIONS, "p_partkey"), catalog.SECTIONS).alias("section"),
    )


_LOW = f"lower({_picked(_NAMES, 'p_partkey')} || ' ' || p_type)"


@query(f"""select p_partkey as id, case when p_size % 2 = 0 then case when regexp_matches({_LOW}, '{catalog.STANDARD}') and not regexp_matches({_LOW}, '{catalog.LEGAL}') then 'standard' when regexp_matches({_LOW}, '{catalog.POLICY}') then 'policy' else 'regulation' end
          else {_ladder(_LOW, catalog.CATEGORIES, "'other'")} end as category from part""")
def evidence_categories(t: Tables) -> DataFrame:
    section = F.when(F.col("p_size") % 2 == 0, "Regulatory Requirements").otherwise("Global Drivers")
    return t.part.select(F.col("p_partkey").alias("id"), catalog.category(section, _pick(_NAMES, "p_partkey"), F.col("p_type")).alias("category"))


_TITLE = _picked(_NAMES, "doc_id")


@query(f"""select doc_id, regexp_matches({_TITLE} || ' ' || text, '{catalog.OBLIGATION}') as obligation, regexp_matches({_TITLE} || ' ' || text, '{catalog.HARD_CLAIM}') as hard_claim, regexp_matches(trim({_TITLE}), '{catalog.WEAK_TITLE}') as weak_title from documents""")
def claim_language(t: Tables) -> DataFrame:
    """Whether whole texts state obligations or hard claims, and whether titles say anything."""
    title = _pick(_NAMES, "doc_id")
    text = F.concat(title, F.lit(" "), "text")
    return t.documents.select("doc_id", text.rlike(catalog.OBLIGATION).alias("obligation"), text.rlike(catalog.HARD_CLAIM).alias("hard_claim"), F.trim(title).rlike(catalog.WEAK_TITLE).alias("weak_title"))


@query()
def protected_tokens(t: Tables) -> DataFrame:
    """Metrics and acronyms of the benchmark's texts."""
    return t.benchmark.select("item_id", catalog.protected(F.col("text"), metrics.metrics(F.col("text"))).alias("tokens"))


_LINE = "case user_id % 3 when 0 then 'opened /esg/news/' || user_id || ' (x)' when 1 then 'Read /CREDIT/t' || user_id || ') ' else 'login' end"


@query(rf"""with d as (select event_id, nullif(regexp_extract({_LINE}, '(?i)/(?:esg|credit)/[^\s)•]+', 0), '') as path from events)
          select event_id, path, case when starts_with(path, '/credit/') then 'credit' when starts_with(path, '/esg/') then 'esg' end as domain from d""")
def activity_paths(t: Tables) -> DataFrame:
    user = F.col("user_id").cast("string")
    opened, read = F.concat(F.lit("opened /esg/news/"), user, F.lit(" (x)")), F.concat(F.lit("Read /CREDIT/t"), user, F.lit(") "))
    line = F.when(F.col("user_id") % 3 == 0, opened).when(F.col("user_id") % 3 == 1, read).otherwise("login")
    return t.events.select("event_id", catalog.activity_path(line).alias("path"), catalog.activity_domain(line).alias("domain"))


@query("""select o_orderkey as id, case when o_orderkey % 11 = 0 then '—' else regexp_replace(regexp_replace(format('{:,.2f}', round(o_totalprice / 7, 2)), '0+$', ''), '\\.$', '') || case when o_orderkey % 2 = 0 then ' USD' else '' end end as shown from orders""")
def amount_texts(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 7)
    return t.orders.select(F.col("o_orderkey").alias("id"), catalog.amount_text(value, F.when(F.col("o_orderkey") % 2 == 0, "USD")).alias("shown"))


@query(f"""with p as (select p_partkey as id, {_picked(_PERIODS, 'p_partkey')} as v from part) select id, case when contains(v, '2027') then date '2027-12-01' when contains(v, 'Март') then date '2025-03-01' when contains(v, '2026') then date '2026-12-31' when contains(v, 'ноября') then date '2025-12-31' end as ends from p""")
def russian_periods(t: Tables) -> DataFrame:
    """Ends of periods; a month in another case than the nominative is not known, as in the rule."""
    return t.part.select(F.col("p_partkey").alias("id"), catalog.period_end(_pick(_PERIODS, "p_partkey")).alias("ends"))


@query("select event_id, cast(date_trunc('week', ts) as date) as reference_date from events")
def digest_reference(t: Tables) -> DataFrame:
    """The day after the end of the week before: digests of that week are made again from it."""
    return t.events.select("event_id", F.date_add(previous_week(F.col("ts"))[1], 1).alias("reference_date"))


@query("""with h as (select event_id, event_type, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(event_type || '-' || user_id, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) as n from events)
          select event_id, lower(to_base(n, 36)) as token, event_id % 2 = 0 as whole from h""")
def short_tokens(t: Tables) -> DataFrame:
    """Hash tokens in base 36, and whether an id has the form of a UUID."""
    made = F.when(F.col("event_id") % 2 == 0, "0a1b2c3d-0000-4000-8000-0123456789AB").otherwise("0a1b2c3d-0000-0000-8000-0123456789ab")
    return t.events.select("event_id", evidence.token(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))).alias("token"), evidence.is_uuid(made).alias("whole"))


@query(f"""with s as (select s_suppkey as id, case when s_suppkey % 2 = 0 then 'kz' else 'uae' end as w, {_listed(_URLS)} as u from supplier),
          e as (select distinct id, w, url, min(i) over (partition by id, url) as i from (select id, w, unnest(u) as url, unnest(range(len(u))) as i from s) where url <> ''),
          r as (select id, url, row_number() over (partition by id order by not contains(lower(url), w), i) as place from e) select id, string_agg(url, ' ' order by place) as urls from r where place <= 4 group by 1""")
def country_first_urls(t: Tables) -> DataFrame:
    words = F.array(F.when(F.col("s_suppkey") % 2 == 0, "kz").otherwise("uae"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.array_join(catalog.country_first(F.array(*(F.lit(u) for u in _URLS)), words), " ").alias("urls"))


@query(r"""select doc_id, nullif(substr(trim(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), 1, 160), '') as title, case when doc_id % 3 = 0 then 'http://a.b/' || doc_id end as url from documents""")
def progress_lines(t: Tables) -> DataFrame:
    """Texts of a log without runs of white space, cut to their column, and only links to the web."""
    url = F.concat(F.when(F.col("doc_id") % 3 == 0, "http://a.b/").otherwise("ftp://a.b/"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", catalog.cleaned(F.col("text"), 160).alias("title"), catalog.web_link(url).alias("url"))


@query("""with r as (select user_id as source, cast(ts as date) as run, count(*) as found, count(*) filter (where event_type = 'signup') as fresh, count(*) filter (where event_type = 'error') as failed,
          cast(floor(epoch(max(ts) - min(ts))) as bigint) as seconds from events group by 1, 2)
          select source, count(*) as scrapes, count(*) filter (where failed = 0) as good, count(*) filter (where failed > 0) as bad, sum(fresh)::bigint as fresh, sum(found)::bigint as found, sum(seconds)::bigint as seconds, max_by(case when failed > 0 then 'partial' else 'success' end, run) as last_status from r group by 1""")
def scrape_statistics(t: Tables) -> DataFrame:
    """Runs by source and day, then a source's counters and the state of its last run."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    seconds = F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1000000)
    runs = t.events.groupBy(F.col("user_id").alias("source"), F.col("ts").cast("date").alias("run")).agg(F.count("*").alias("found"), of("signup").alias("fresh"), of("error").alias("failed"), seconds.alias("seconds"))
    status = F.when(F.col("failed") > 0, "partial").otherwise("success")
    return runs.groupBy("source").agg(
        F.count("*").alias("scrapes"), F.count_if(F.col("failed") == 0).alias("good"), F.count_if(F.col("failed") > 0).alias("bad"), F.sum("fresh").alias("fresh"),
        F.sum("found").alias("found"), F.sum("seconds").alias("seconds"), F.max_by(status, "run").alias("last_status"),
    )


@query("select id, place from (select o_orderkey as id, row_number() over (partition by o_custkey order by o_orderstatus desc, o_orderdate desc, o_orderkey)::int as place from orders) where place <= 5")
def status_then_newest(t: Tables) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderstatus"), F.desc("o_orderdate"), "o_orderkey")
    return t.orders.withColumn("place", F.row_number().over(order)).filter("place <= 5").select(F.col("o_orderkey").alias("id"), "place")


@query("""with d as (select p_partkey as id, p_brand as pack, list_position(['PROMO', 'ECONOMY', 'STANDARD'], split_part(p_type, ' ', 1)) as section, case when p_partkey % 6 > 0 then p_size end as confidence from part)
          select id, row_number() over (partition by pack order by coalesce(section, 99), coalesce(confidence, 0) desc, id)::int as place from d""")
def pack_order(t: Tables) -> DataFrame:
    """Drivers of a pack by their section's place in a fixed order, unknown ones last, then the surest; null counts as 0."""
    known = F.array(F.lit("PROMO"), F.lit("ECONOMY"), F.lit("STANDARD"))
    section = F.nullif(F.array_position(known, F.split("p_type", " ")[0]), F.lit(0))
    sure = F.when(F.col("p_partkey") % 6 > 0, F.col("p_size"))
    order = Window.partitionBy("p_brand").orderBy(F.coalesce(section, F.lit(99)), F.coalesce(sure, F.lit(0)).desc(), "p_partkey")
    return t.part.select(F.col("p_partkey").alias("id"), F.row_number().over(order).alias("place"))


@query("select event_id as id, coalesce(nullif(event_type, 'view'), 'Untitled Event') as title, strftime(ts, '%Y-%m-%d') as start_date, case when event_id % 2 = 0 then props end as checkpoint, 'https://e.com/' || user_id as url from events")
def list_items(t: Tables) -> DataFrame:
    """List items with fallbacks; a wide JSON column travels only where it is asked for."""
    url = F.concat(F.lit("https://e.com/events/"), F.col("user_id").cast("string"))
    return t.events.select(
        F.col("event_id").alias("id"), F.coalesce(F.nullif(F.col("event_type"), F.lit("view")), F.lit("Untitled Event")).alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("start_date"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("checkpoint"), F.replace(url, F.lit("e.com/events/"), F.lit("e.com/")).alias("url"),
    )


def _raw(t: Tables) -> DataFrame:
    lots = F.array(F.struct(F.col("o_orderkey").alias("n")))
    buyer = F.struct(F.col("o_custkey").alias("id"), F.lit(" ").alias("note"), F.col("o_orderpriority").alias("orderRank"))
    steps = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(F.col("o_orderstatus").alias("name")), F.struct(F.lit("z").alias("name"))))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(lots.alias("_lots"), buyer.alias("buyer_info"), steps.alias("steps"), F.lit("x").alias("flat"))).alias("json"))


@query("select o_orderkey as id, 'Buyer info' as title, '3 fields' as summary from orders union all select o_orderkey, 'Steps', '2 items' from orders where o_orderkey % 3 = 0")
def json_sections(t: Tables) -> DataFrame:
    """Nested parts of raw JSON records with their sizes."""
    return variants.sections(_raw(t), "id", "json").drop("field")


@query("""select o_orderkey as id, unnest(['_lots', '_lots/0', '_lots/0/n', 'buyer_info', 'buyer_info/id', 'buyer_info/orderRank', 'flat']) as path, unnest(['sequence', 'mapping', 'scalar', 'mapping', 'scalar', 'scalar', 'scalar']) as kind,
          unnest(['Lots', 'Item 1', 'N', 'Buyer info', 'ID', 'OrderRank', 'Flat']) as title, unnest([null, null, o_orderkey::varchar, null, o_custkey::varchar, o_orderpriority, 'x']) as value from orders
          union all select o_orderkey, unnest(['steps', 'steps/0', 'steps/0/name', 'steps/1', 'steps/1/name']), unnest(['sequence', 'mapping', 'scalar', 'mapping', 'scalar']), unnest(['Steps', o_orderstatus, 'Name', 'z', 'Name']), unnest([null, null, o_orderstatus, null, 'z']) from orders where o_orderkey % 3 = 0""")
def json_tree(t: Tables) -> DataFrame:
    """Raw JSON records as nodes to show, without empty ones."""
    return variants.presented(_raw(t), "id", "json")


def _notices(t: Tables) -> DataFrame:
    """Orders as raw notices of four sources."""
    k = F.col("o_orderkey")
    source = F.array(*map(F.lit, ["goszakup", "mitwork", "zakup_unified", "ets_tender"]))[(k % 4).cast("int")]
    number = F.when(k % 3 == 0, "").when(k % 3 == 1, k.cast("string"))
    detail = F.when(k % 4 == 1, F.struct(F.lit("").alias("value_text"), F.concat(F.lit("s"), (k % 7).cast("string")).alias("offer_start_text"), F.lit("T").alias("title_ru_detail")))
    status = F.when(k % 4 == 2, F.struct(F.col("o_orderstatus").alias("name"), (k % 2).alias("code")))
    whole = F.struct(
        number.alias("announcement_number"), k.alias("announcement_id"), k.alias("id"), F.col("o_orderstatus").alias("status_text"), F.col("o_custkey").cast("string").alias("value_text"), F.col("o_orderpriority").alias("title_ru"),
        F.col("o_orderpriority").alias("name"), detail.alias("detail_fields"), status.alias("status"), F.array(F.struct(F.lit(1).alias("n"))).alias("_lots"),
    )
    return t.orders.select(k.alias("id"), source.alias("source"), F.to_json(whole).alias("json"))


@query("""
    with o as (select o_orderkey as id, (o_orderkey % 4)::int as s, (o_orderkey % 3)::int as m, o_orderkey::varchar as k, o_orderstatus as status, o_orderpriority as p, o_custkey::varchar as c from orders),
    plain as (select id, unnest(list_filter([case when m = 1 then {'l': 'Announcement number', 'v': k} end, {'l': 'Announcement ID', 'v': k}, {'l': 'ID', 'v': k}, {'l': 'Status text', 'v': status}, {'l': 'Value text', 'v': c}, {'l': 'Title (RU)', 'v': p}, {'l': 'Name', 'v': p}], lambda x: x is not null)) as x,
                     unnest(range(case when m = 1 then 7 else 6 end)) as place from o where s = 3),
    shown as (
      select id, 'eyebrow' as part, 0 as place, 'eyebrow' as label, (['Портал государственных закупок', 'Eurasian Electronic Portal', 'Unified Procurement Portal of Kazakhstan', 'ETS-Tender'])[s + 1] as value from o
      union all select id, 'heading', 0, 'heading', case s when 0 then 'Просмотр объявления № ' || case when m = 0 then '' else k end when 1 then 'Закупка № ' || case when m = 1 then k else '' end when 2 then 'Объявление № ' || case when m = 0 then '' else k end else k end from o
      union all select id, 'subtitle', 0, 'subtitle', case s when 1 then 'T' when 0 then null else p end from o
      union all select id, 'status', 0, 'status', case when s = 3 then '' else status end from o
      union all select id, 'cards', 0, 'Номер объявления', k from o where s = 0 and m = 1 union all select id, 'cards', 1, 'Статус', status from o where s = 0
      union all select id, 'cards', 0, 'Начало приема', 's' || (id % 7) from o where s = 1 union all select id, 'Основные данные', 0, 'Номер закупки', k from o where s = 1 and m = 1 union all select id, 'Основные данные', 2, 'Наименование (RU)', 'T' from o where s = 1
      union all select id, 'cards', 2, 'Лоты', '1' from o where s = 2 union all select id, 'cards', 3, 'Код статуса', (id % 2)::varchar from o where s = 2 union all select id, 'Данные объявления', 0, 'ID объявления', k from o where s = 2
      union all select id, 'Данные объявления', 2, 'Номер объявления', k from o where s = 2 and m = 1 union all select id, 'Данные объявления', 3, 'Наименование', p from o where s = 2
      union all select id, 'Source profile', place, x.l, x.v from plain union all select id, 'cards', place, x.l, x.v from plain where place < 4)
    select id, part, place::int as place, label, value from shown""")
def source_views(t: Tables) -> DataFrame:
    """What is shown of raw notices of four sources, by the table of fields."""
    return views.source_views(_notices(t))


@query("""
    with o as (select o_orderkey as id, (o_orderkey % 4)::int as s, (o_orderkey % 3)::int as m, o_orderkey::varchar as k, o_orderstatus as status, o_orderpriority as p, o_custkey::varchar as c from orders)
    select id, 'Identity' as bucket, 'announcement_number' as field, 'Announcement number' as label, k as value from o where m = 1 union all select id, 'Identity', 'announcement_id', 'Announcement ID', k from o
    union all select id, 'Identity', 'id', 'ID', k from o union all select id, 'Process', 'status_text', 'Status text', status from o union all select id, 'Commercial', 'value_text', 'Value text', c from o
    union all select id, 'Identity', 'title_ru', 'Title (RU)', p from o union all select id, 'Identity', 'name', 'Name', p from o""")
def json_groups(t: Tables) -> DataFrame:
    """Scalar fields of raw notices in the groups in which they are shown."""
    return variants.groups(_notices(t), "id", "json")
