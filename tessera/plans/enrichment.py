"""Lookups, references, evidence rules, JSON views and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import evidence, variants
from tessera.operators import claims, joins
from tessera.plans.registry import AS_OF, Tables, query
from tessera.plans.relational import _LIKES, likes, users

_DRIVERS = """(select p_partkey as id, ['s' || (p_partkey % 50), 's' || (p_partkey % 7 + 9000)] as refs, ['u' || (p_partkey % 30), 'u' || (p_partkey % 11)] as links from part)"""
_SOURCES = "(select 's' || s_suppkey as source_id, 'u' || (s_suppkey % 40) as url from supplier)"


def _drivers(t: Tables) -> DataFrame:
    named = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.array(named("s", k % 50), named("s", k % 7 + 9000)).alias("refs"), F.array(named("u", k % 30), named("u", k % 11)).alias("links"))


def _sources(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("source_id"), F.concat(F.lit("u"), (k % 40).cast("string")).alias("url"))


@query(f"select id, string_agg(source_id, ', ' order by source_id) as sources from (select distinct d.id, s.source_id from {_DRIVERS} d join {_SOURCES} s on list_contains(refs, source_id) or list_contains(links, url)) group by 1")
def driver_sources(t: Tables) -> DataFrame:
    return joins.referenced_lists(_drivers(t), "id", "refs", "links", _sources(t))


@query(f"""with m as (select distinct d.id, s.source_id, list_contains(refs, source_id) as by_ref from {_DRIVERS} d join {_SOURCES} s on list_contains(refs, source_id) or list_contains(links, url))
          select id, source_id from m qualify by_ref or not bool_or(by_ref) over (partition by id)""")
def driver_sources_fallback(t: Tables) -> DataFrame:
    return joins.referenced_or_linked(_drivers(t), "id", "refs", "links", _sources(t))


@query("""with f as (select event_id, case when event_type = 'click' then 'part' else 'document' end as kind, cast(json_extract_string(props, '$.k') as bigint) as id from events),
          d as (select 'document' as kind, doc_id as id, substr(text, 1, 20) as title, 0 as place from documents where doc_id % 2 = 0
                union all select 'document', doc_id, source, 1 from documents union all select 'part', p_partkey, p_name, 0 from part where p_size < 25)
          select event_id, f.kind, f.id, min_by(title, place) as title, min(place) as place from f left join d on d.kind = f.kind and d.id = f.id group by 1, 2, 3""")
def content_lookup(t: Tables) -> DataFrame:
    """A title from the preferred domain, else from the other one; the last kind is there only in part."""
    kind = F.when(F.col("event_type") == "click", "part").otherwise("document")
    facts = t.events.select("event_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("id"))
    doc = t.documents.withColumn("kind", F.lit("document")).withColumnRenamed("doc_id", "id")
    part = t.part.filter("p_size < 25").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    own = doc.filter("id % 2 = 0").select("kind", "id", F.substring("text", 1, 20).alias("title")).unionByName(part)
    return joins.first_of(facts, ["kind", "id"], [own, doc.select("kind", "id", F.col("source").alias("title"))]).select("event_id", "kind", "id", "title", "place")


@query("""select c_custkey as user_id, count(*) as n from customer left join events on user_id = c_custkey where ts > timestamp '2024-01-20' and event_type <> 'error' group by 1""")
def outer_degraded_by_filter(t: Tables) -> DataFrame:
    """The filter on the right side leaves out users without a row."""
    joined = users(t).join(t.events.withColumnRenamed("user_id", "u"), F.col("user_id") == F.col("u"), "left")
    return joined.filter("ts > timestamp_ntz '2024-01-20' and event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""select c_mktsegment as team, count(distinct p.id) as prefs, count(s.event_id) as sent, max(s.ts) as last_sent
          from (select o_orderkey as id, o_custkey as user_id from orders where o_orderstatus = 'O') p
          left join (select event_id, user_id, ts from events where event_type = 'purchase') s on s.user_id = p.user_id join customer on c_custkey = p.user_id group by 1""")
def prefs_sent_users(t: Tables) -> DataFrame:
    prefs = t.orders.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    sent = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count("event_id").alias("sent"), F.max("ts").alias("last"))
    by_user = prefs.groupBy("user_id").agg(F.count("id").alias("prefs")).join(sent, "user_id", "left").join(users(t), "user_id")
    return by_user.groupBy("team").agg(F.sum("prefs").alias("prefs"), F.sum(F.col("prefs") * F.coalesce("sent", F.lit(0))).alias("sent"), F.max("last").alias("last_sent"))


@query("select event_id, coalesce(c_name, 'System') as user_name from events left join customer on c_custkey = user_id and c_mktsegment <> 'BUILDING'")
def activity_with_user(t: Tables) -> DataFrame:
    known = users(t).filter("team <> 'BUILDING'").select("user_id", "name")
    return t.events.join(known, "user_id", "left").select("event_id", F.coalesce("name", F.lit("System")).alias("user_name"))


@query("""with s as (select o_orderkey as id, o_orderpriority || '/' || (o_custkey % 9) as subject, o_orderstatus as status from orders)
          select id, case when subject = (select subject from s where id = 3) and status = 'O' then 'sent' else status end as status from s""")
def mark_by_subject(t: Tables) -> DataFrame:
    """All rows with the subject of one, not that one alone."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 9).cast("string")).alias("subject"), F.col("o_orderstatus").alias("status"))
    wanted = rows.filter("id = 3").select("subject", F.lit(True).alias("hit"))
    marked = rows.join(wanted, "subject", "left")
    return marked.select("id", F.when(F.col("hit") & (F.col("status") == "O"), "sent").otherwise(F.col("status")).alias("status"))


@query("select o_orderkey as id from orders p where o_orderstatus = 'F' and exists (select 1 from orders c where c.o_orderkey % 5 = 0 and c.o_orderkey // 5 = p.o_orderkey)")
def resumed_parents(t: Tables) -> DataFrame:
    children = t.orders.filter("o_orderkey % 5 = 0").select(F.floor(F.col("o_orderkey") / 5).alias("parent"))
    return t.orders.filter("o_orderstatus = 'F'").join(children, F.col("o_orderkey") == F.col("parent"), "left_semi").select(F.col("o_orderkey").alias("id"))


@query("""select c_name as company, coalesce(cast(a.n as varchar), '-') as orders, coalesce(cast(b.n as varchar), '-') as likes, coalesce(cast(e.n as varchar), '-') as errors from customer
          left join (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'P' group by 1) a on a.k = c_custkey
          left join (select user_id as k, count(*) as n from events where event_type = 'click' group by 1) b on b.k = c_custkey
          left join (select user_id as k, count(*) as n from events where event_type = 'error' group by 1) e on e.k = c_custkey""")
def row_enrichment(t: Tables) -> DataFrame:
    count = lambda df, key: df.groupBy(F.col(key).alias("user_id")).agg(F.count("*").alias("value"))
    kind = lambda name: count(t.events.filter(F.col("event_type") == name), "user_id")
    tables = {"orders": count(t.orders.filter("o_orderstatus = 'P'"), "o_custkey"), "likes": kind("click"), "errors": kind("error")}
    return joins.enriched(users(t), "user_id", tables).select(F.col("name").alias("company"), "orders", "likes", "errors")


@query("""select c_custkey as id, case when c_custkey % 10 = 0 then '' when c_custkey % 7 = 0 then 'Error' when n is null then 'Not Found' when n % 4 = 0 then 'No Data' else 'r' || n end as state
          from customer left join (select o_custkey as k, count(*) as n from orders group by 1) on k = c_custkey""")
def enrichment_states(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"))
    joined = users(t).join(n, "user_id", "left")
    name = F.when(F.col("user_id") % 10 == 0, F.lit("  ")).otherwise(F.col("name"))
    value = F.when(F.col("n") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), F.col("n").cast("string")))
    return joined.select(F.col("user_id").alias("id"), joins.enrichment_state(name, F.col("n").isNotNull(), F.col("user_id") % 7 == 0, value).alias("state"))


@query("""select p_brand as name, min_by(p_name, p_partkey) as suggestion from part where contains(lower(p_name), lower(substr(p_type, 1, 1))) group by 1""")
def first_suggestion(t: Tables) -> DataFrame:
    """Of the suggestions that came for a name, in order, the first that contains what was asked."""
    fits = t.part.filter(F.lower("p_name").contains(F.lower(F.substring("p_type", 1, 1))))
    return fits.groupBy(F.col("p_brand").alias("name")).agg(F.min_by("p_name", "p_partkey").alias("suggestion"))


_EVIDENCE = """(select l_orderkey as id, count(*) as sources, avg(l_quantity)::double as average, max(l_quantity) >= 45 as authoritative, max(l_suppkey) % 5 = 0 as bad_label, max(l_suppkey) % 7 = 0 as bad_metric,
              max(l_suppkey) % 3 = 0 as weak_title, (max(l_partkey) % 100)::double as model, case when max(l_partkey) % 2 = 0 then 'net zero framework' else 'growth' end as indicator from lineitem group by 1)"""
_SURE = """greatest(case when sources >= 1 and authoritative and not bad_label and not bad_metric and not weak_title then 75 else 35 end, least(96, cast(floor(0.55::double * average + 0.25::double * model + case when indicator = 'net zero framework' then 10 else 0 end
          + least(sources * 5, 15) - case when bad_label then 8 else 0 end - case when bad_metric then 20 else 0 end - case when weak_title then 8 else 0 end + 0.5::double) as int)))"""


def _evidence(t: Tables) -> DataFrame:
    supp, part = F.max("l_suppkey"), F.max("l_partkey")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("sources"), F.avg("l_quantity").cast("double").alias("average"), (F.max("l_quantity") >= 45).alias("authoritative"),
        (supp % 5 == 0).alias("bad_label"), (supp % 7 == 0).alias("bad_metric"), (supp % 3 == 0).alias("weak_title"), (part % 100).cast("double").alias("model"),
        F.when(part % 2 == 0, "net zero framework").otherwise("growth").alias("indicator"),
    )


def _sure() -> F.Column:
    names = ("average", "model", "indicator", "sources", "authoritative", "bad_label", "bad_metric", "weak_title")
    return evidence.derived_confidence(*(F.col(c) for c in names))


@query(f"select id, cast({_SURE} as int) as confidence from {_EVIDENCE}")
def confidence_derived(t: Tables) -> DataFrame:
    return _evidence(t).select("id", _sure().alias("confidence"))


@query(f"""with v as (select *, cast({_SURE} as int) as confidence, (100 - 10 * (bad_label::int + bad_metric::int + weak_title::int))::int as score from {_EVIDENCE})
          select case when not bad_label and not bad_metric and score >= 75 and least(confidence, cast(model as int)) >= 75 then 'accept'
                      when (bad_label or bad_metric or model < 75) and id % 2 = 0 and sources % 3 > 0 then 'augment' when id % 4 > 0 and id % 5 <= 2 then 'repair' else 'fail' end as route, count(*) as n from v group by 1""")
def verification_route(t: Tables) -> DataFrame:
    issues = F.col("bad_label").cast("int") + F.col("bad_metric").cast("int")
    score = 100 - 10 * (issues + F.col("weak_title").cast("int"))
    ways = evidence.route(~F.col("bad_label") & ~F.col("bad_metric"), score, _sure(), F.col("model").cast("int"), issues, F.col("id") % 2, F.col("sources") % 3, F.col("id") % 4 > 0, F.col("id") % 5)
    return _evidence(t).groupBy(ways.alias("route")).agg(F.count("*").alias("n"))


@query(f"select id, case when sources <= 1 then least(confidence, 60) when bad_metric then least(confidence, 70) else confidence end as confidence from (select *, cast({_SURE} as int) as confidence from {_EVIDENCE})")
def confidence_caps(t: Tables) -> DataFrame:
    return _evidence(t).select("id", evidence.capped_confidence(_sure(), F.col("sources") > 1, ~F.col("bad_metric")).alias("confidence"))


_FIELDS = {"Name_1": "c_name", "creditLine": "c_mktsegment", "startDay": "c_nationkey", "unit_price": "c_acctbal", "buyerCity": "c_nationkey", "procedure": "c_mktsegment", "doc_url": "c_name", "extra": "c_custkey"}
_BUCKETS = {"Name_1": "Identity", "creditLine": "Additional facts", "startDay": "Timeline", "unit_price": "Commercial", "buyerCity": "Parties", "procedure": "Process", "doc_url": "References", "extra": "Additional facts"}


@query(f"select bucket, count(*) as n, count(distinct id) as records from ({' union all '.join(f'''select c_custkey as id, '{_BUCKETS[k]}' as bucket, cast({v} as varchar) as v from customer''' for k, v in _FIELDS.items())}) where trim(v) <> '' group by 1")
def json_pretty_buckets(t: Tables) -> DataFrame:
    """The fields of a raw JSON record by the group they are shown in; empty ones are not shown."""
    raw = t.customer.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(*(F.col(v).cast("string").alias(k) for k, v in _FIELDS.items()))).alias("json"))
    filled = F.map_keys(F.map_filter(F.from_json("json", "map<string,string>"), lambda _, v: F.trim(v) != ""))
    return evidence.bucket_counts(raw.select("id", filled.alias("keys")), "id", "keys")


@query("select o_orderkey as id, o_custkey as lot, o_orderkey % 7 as amount from orders where o_orderkey % 5 > 0 union all select o_orderkey, 0, null from orders where o_orderkey % 2 = 0 and o_orderkey % 5 > 0")
def json_records(t: Tables) -> DataFrame:
    """The records in an array below one key of a raw JSON record, among other items; what is no array has none."""
    k = F.col("o_orderkey").cast("string")
    item = F.concat(F.lit('{"lot":'), F.col("o_custkey").cast("string"), F.lit(',"amount":'), (F.col("o_orderkey") % 7).cast("string"), F.lit("}"))
    more = F.when(F.col("o_orderkey") % 2 == 0, F.lit(',{"lot":0},"x",[{"lot":9}]')).otherwise(F.lit(",null"))
    listed = F.concat(F.lit("[1,"), item, more, F.lit("]"))
    raw = t.orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit('{"k":'), k, F.lit(',"_lots":'), F.when(F.col("o_orderkey") % 5 > 0, listed).otherwise('{"lot":1}'), F.lit("}")).alias("json"))
    found = variants.records_below(raw, "id", "json", "_lots")
    return found.select("id", F.try_variant_get("item", "$.lot", "long").alias("lot"), F.try_variant_get("item", "$.amount", "long").alias("amount"))


@query("""select o_orderkey as id, unnest(list_concat(['p' || (o_custkey % 5)], ['t' || (o_custkey % 3), 't9'])) as mark from orders""")
def match_trail(t: Tables) -> DataFrame:
    """Phrases, then tokens, of a record's match groups as rows."""
    k = F.col("o_custkey")
    group = F.create_map(F.lit("matched_phrases"), F.array(F.concat(F.lit("p"), (k % 5).cast("string"))), F.lit("matched_tokens"), F.array(F.concat(F.lit("t"), (k % 3).cast("string")), F.lit("t9")))
    none = F.array().cast("array<string>")
    marks = F.concat(F.coalesce(F.col("g")["matched_phrases"], none), F.coalesce(F.col("g")["matched_tokens"], none))
    return t.orders.select(F.col("o_orderkey").alias("id"), group.alias("g")).select("id", F.explode(marks).alias("mark"))


@query(f"select event_type as kind, count(*) filter (where user_id % 2 = 0) as esg, count(*) filter (where user_id % 2 = 1) as credit, count(*) as total from events group by 1")
def likes_by_type_split(t: Tables) -> DataFrame:
    odd = F.col("user_id") % 2 == 1
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count_if(~odd).alias("esg"), F.count_if(odd).alias("credit"), F.count("*").alias("total"))


@query(f"select count(*) as n_likes from {_LIKES} where content_id = 7")
def like_count_of_one(t: Tables) -> DataFrame:
    return likes(t).filter("content_id = 7").agg(F.count("*").alias("n_likes"))


@query(f"""select cast(round(avg(confidence) filter (where confidence >= 50)) as int) as mean_confidence, count(*) filter (where confidence >= 50) as kept, count(*) filter (where confidence < 50) as omitted from (select cast({_SURE} as int) as confidence from {_EVIDENCE})""")
def export_summary(t: Tables) -> DataFrame:
    kept = F.col("confidence") >= 50
    rows = _evidence(t).select(_sure().alias("confidence"))
    return rows.agg(F.round(F.avg(F.when(kept, F.col("confidence")))).cast("int").alias("mean_confidence"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("omitted"))


@query("""
    with s as (select l_partkey as id, count(*) as n, max(l_quantity * 2) as best, bool_and(l_quantity * 2 < 60 and l_discount * 1000 < 60) as weak from lineitem where l_linenumber > 4 group by 1),
    d as (select p_partkey as id, p_size + 50 as sure, p_partkey % 5 = 0 as warned, p_partkey % 7 = 0 as generic, p_partkey % 3 > 0 as specific, p_partkey % 4 = 0 as projected, coalesce(n, 0) as n, coalesce(best, 0) as best, coalesce(weak, false) as weak from part left join s on s.id = p_partkey),
    r as (select *, list_filter([case when warned then 'check the year' end, case when n = 0 then 'no parsed source detail' end, case when generic then 'generic source label' end, case when not specific and not projected then 'evidence/KPI is not specific' end,
            case when projected and best < 70 then 'projection needs direct citation' end, case when sure < 70 then 'confidence ' || sure end, case when weak then 'weak source mix' end], lambda x: x is not null) as reasons from d),
    v as (select *, case when sure >= 80 and len(reasons) = 0 then 'strong' when sure < 70 or generic or (projected and best < 70) or len(reasons) >= 2 then 'limited' else 'checked' end as level from r)
    select id as driver_id, level, array_to_string(case when len(reasons) > 0 or level = 'strong' then reasons when level = 'limited' then ['source support is limited'] else ['moderate confidence'] end, '|') as reasons from v""")
def accuracy_summary(t: Tables) -> DataFrame:
    """How far each driver can be relied on, with reasons."""
    k = F.col("p_partkey")
    indicator = F.when(k % 4 == 0, "It is expected to reach 5%").when(k % 3 > 0, "Scope of the rule").otherwise("growth of trade")
    drivers = t.part.select(
        k.alias("driver_id"), F.when(k % 5 == 0, F.array(F.lit("check the year"), F.lit("check the year "))).alias("warnings"), F.array(F.when(k % 7 == 0, " Source 12").otherwise("IEA")).alias("key_sources"), indicator.alias("indicator"), (F.col("p_size") + 50).alias("confidence"),
    )
    sources = t.lineitem.filter("l_linenumber > 4").select(F.col("l_partkey").alias("driver_id"), (F.col("l_quantity") * 2).alias("authority"), (F.col("l_discount") * 1000).alias("score"))
    found = claims.accuracy_review(drivers, sources)
    return found.select("driver_id", "level", F.array_join("reasons", "|").alias("reasons"))


@query("""select user_id as slot, count(*) filter (where event_type = 'view') as searches, count(*) filter (where event_type = 'click') as reviews,
          count(distinct case when event_type = 'purchase' then json_extract_string(props, '$.k') end) as approved, min(ts) as started from events group by 1""")
def slot_states(t: Tables) -> DataFrame:
    is_ = lambda name: F.col("event_type") == name
    url = F.when(is_("purchase"), F.get_json_object("props", "$.k"))
    return t.events.groupBy(F.col("user_id").alias("slot")).agg(F.count_if(is_("view")).alias("searches"), F.count_if(is_("click")).alias("reviews"), F.countDistinct(url).alias("approved"), F.min("ts").alias("started"))


@query("select source as url, list_sort(list_distinct(list(lang))) as langs, count(*) as n, min(doc_id) as first_id from documents group by 1")
def seed_rollup(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.col("source").alias("url")).agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("select p_brand as domain, min_by(p_name, p_partkey) as label, count(distinct p_size) as approvals from part group by 1")
def publisher_policy(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("domain")).agg(F.min_by("p_name", "p_partkey").alias("label"), F.countDistinct("p_size").alias("approvals"))


@query("""select count(*) filter (where ts >= timestamp '2024-01-30') as fresh_today, count(distinct case when ts >= timestamp '2024-01-17' then event_type end) as sources_14d,
          count(distinct case when ts > timestamp '2024-01-30' then user_id end) as active_24h, count(*) filter (where ts > timestamp '2024-01-30' and event_type = 'click') as likes_24h from events""")
def home_counters(t: Tables) -> DataFrame:
    after = lambda days: F.col("ts") > F.expr(f"{AS_OF} - interval {days} days")
    return t.events.agg(
        F.count_if(F.col("ts") >= F.expr("timestamp_ntz '2024-01-30'")).alias("fresh_today"), F.countDistinct(F.when(F.col("ts") >= F.expr("timestamp_ntz '2024-01-17'"), F.col("event_type"))).alias("sources_14d"),
        F.countDistinct(F.when(after(1), F.col("user_id"))).alias("active_24h"), F.count_if(after(1) & (F.col("event_type") == "click")).alias("likes_24h"),
    )


@query("select 'customer' as name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'documents', count(*) from documents union all select 'events', count(*) from events")
def record_totals(t: Tables) -> DataFrame:
    counts = [getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("customer", "orders", "documents", "events")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""with c as (select p_size % 5 as slot, p_partkey as id, 0 as tier, p_retailprice as r from part where p_partkey % 3 = 0 union all select p_size % 5, p_partkey, 1, p_retailprice from part where p_partkey % 4 = 0
          union all select p_size % 5, p_partkey, 2, p_retailprice from part), o as (select slot, id, min((tier, r)) as seat from c group by 1, 2)
          select slot, id, row_number() over (partition by slot order by seat, id)::int as place from o""")
def slot_queue(t: Tables) -> DataFrame:
    parts = t.part.select((F.col("p_size") % 5).alias("slot"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("r"))
    return joins.queue_of_slots([parts.filter("id % 3 = 0"), parts.filter("id % 4 = 0"), parts], "slot", "id", "r")


@query("""select p_publisher as publisher, base, 'site:' || p_publisher || '.org ' || base as q from (select distinct lower(source) as p_publisher from documents where source is not null) , (values ('policy'), ('targets')) b(base)""")
def site_queries(t: Tables) -> DataFrame:
    """Each publisher's domain with each of the fixed base queries."""
    names = t.documents.filter("source is not null").select(F.lower("source").alias("publisher")).distinct()
    rows = names.select("publisher", F.explode(F.array(F.lit("policy"), F.lit("targets"))).alias("base"))
    return rows.select("publisher", "base", F.concat(F.lit("site:"), "publisher", F.lit(".org "), "base").alias("q"))


@query("""with r as (select l_orderkey as id, l_linenumber as n, 'q' || (l_quantity::int % 4) || ' [' || l_returnflag || ']' as why from lineitem),
          d as (select id, why, min(n) as seen from r group by 1, 2) select id, string_agg(why, '; ' order by seen, why) as summary from (select * from d qualify row_number() over (partition by id order by seen, why) <= 3) group by 1""")
def rejection_summary(t: Tables) -> DataFrame:
    why = F.concat(F.lit("q"), (F.col("l_quantity").cast("int") % 4).cast("string"), F.lit(" ["), "l_returnflag", F.lit("]"))
    once = t.lineitem.groupBy(F.col("l_orderkey").alias("id"), why.alias("why")).agg(F.min("l_linenumber").alias("at"))
    first = once.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("at", "why"))).filter("r <= 3")
    return first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "why"))), lambda x: x["why"]), "; ").alias("summary"))
