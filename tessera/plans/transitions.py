"""Upserts, queue outcomes, gates, orders and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import evidence
from tessera.operators import joins, scraping
from tessera.plans.registry import AS_OF, Tables, query
from tessera.plans.relational import users


@query("""with a as (select o_custkey as user_id, o_orderpriority as kind, count(*) filter (where o_orderstatus in ('O', 'P') and o_orderkey % 3 > 0) as active from orders group by 1, 2),
          n as (select o_orderkey as id, o_custkey as user_id, o_orderpriority as kind, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as turn from orders where o_orderkey % 3 = 0)
          select id, turn + active <= case when n.kind = '1-URGENT' then 1 else 2 end as accepted from n join a on a.user_id = n.user_id and a.kind = n.kind""")
def concurrency_gate(t: Tables) -> DataFrame:
    """New jobs are let in while their user's active jobs of that type are fewer than its limit.

    What is refused takes no place, so the first ones up to the limit are those let in.
    """
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("kind"), "o_orderstatus", "o_orderdate")
    active = jobs.filter("o_orderstatus in ('O', 'P') and id % 3 > 0").groupBy("user_id", "kind").agg(F.count("*").alias("active"))
    order = Window.partitionBy("user_id", "kind").orderBy("o_orderdate", "id")
    new = jobs.filter("id % 3 = 0").withColumn("turn", F.row_number().over(order)).join(active, ["user_id", "kind"], "left")
    limit = F.when(F.col("kind") == "1-URGENT", 1).otherwise(2)
    return new.select("id", (F.col("turn") + F.coalesce("active", F.lit(0)) <= limit).alias("accepted"))


@query("""select o_orderkey as id, case when o_orderstatus <> 'O' then o_orderstatus when o_orderkey % 5 > 0 then 'sent' when o_orderkey % 4 + 1 >= 3 then 'failed' else 'queued' end as status,
          case when o_orderstatus = 'O' then o_orderkey % 4 + 1 else o_orderkey % 4 end as attempts,
          case when o_orderstatus = 'O' and o_orderkey % 5 = 0 and o_orderkey % 4 + 1 < 3 then timestamp '2024-01-31' + interval 5 minute else o_orderdate end as scheduled from orders""")
def email_queue_outcomes(t: Tables) -> DataFrame:
    """Queued mails with the outcome of one try: sent, queued again in five minutes, failed after three."""
    queued, ok, tries = F.col("o_orderstatus") == "O", F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 4
    again = queued & ~ok & (tries + 1 < 3)
    status = F.when(~queued, F.col("o_orderstatus")).when(ok, "sent").when(again, "queued").otherwise("failed")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.when(queued, tries + 1).otherwise(tries).alias("attempts"),
        F.when(again, F.expr(f"{AS_OF} + interval 5 minutes")).otherwise(F.col("o_orderdate")).alias("scheduled"),
    )


@query("""select o_orderkey as id, case when o_custkey % 7 = 0 and o_orderstatus = 'F' then 'queued' when o_custkey % 7 = 1 then 'paused' else o_orderstatus end as status from orders where o_custkey % 7 <> 2""")
def bulk_actions(t: Tables) -> DataFrame:
    """Retry, pause and delete for chosen users' rows."""
    chosen = lambda k: users(t).filter(F.col("user_id") % 7 == k).select(F.col("user_id").alias("o_custkey"))
    kept = t.orders.join(chosen(2), "o_custkey", "left_anti")
    marks = chosen(0).withColumn("mark", F.lit("retry")).unionByName(chosen(1).withColumn("mark", F.lit("pause")))
    marked = kept.join(marks, "o_custkey", "left")
    status = F.when((F.col("mark") == "retry") & (F.col("o_orderstatus") == "F"), "queued").when(F.col("mark") == "pause", "paused").otherwise(F.col("o_orderstatus"))
    return marked.select(F.col("o_orderkey").alias("id"), status.alias("status"))


@query("""select user_id, count(*) as use_count, count(distinct cast(json_extract_string(props, '$.k') as int)) as likes, max(ts) as last_used from events where event_type = 'click' group by 1""")
def member_upserts(t: Tables) -> DataFrame:
    """Each like counts as a use of its member; a second like of one thing adds no like."""
    liked = t.events.filter("event_type = 'click'")
    return liked.groupBy("user_id").agg(F.count("*").alias("use_count"), F.countDistinct(F.get_json_object("props", "$.k").cast("int")).alias("likes"), F.max("ts").alias("last_used"))


@query("""with r as (select event_id, case when user_id % 4 = 0 then null else user_id end as user_id, cast(json_extract_string(props, '$.k') as int) as article from events)
          select min(event_id) as id, user_id, article, count(*) as n from r group by user_id, article, case when user_id is null then event_id end""")
def conversation_upserts(t: Tables) -> DataFrame:
    """One conversation for a user and article; rows without a user never meet."""
    user = F.when(F.col("user_id") % 4 != 0, F.col("user_id"))
    rows = t.events.select("event_id", user.alias("user_id"), F.get_json_object("props", "$.k").cast("int").alias("article"))
    own = F.when(F.col("user_id").isNull(), F.col("event_id")).alias("own")
    return rows.groupBy("user_id", "article", own).agg(F.min("event_id").alias("id"), F.count("*").alias("n")).select("id", "user_id", "article", "n")


@query("""select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and current row)::bigint as tokens,
          max(turn % 4) over (partition by conv_id order by turn rows between unbounded preceding and current row) as progress from conversations""")
def running_counters(t: Tables) -> DataFrame:
    """Running totals of a conversation, and a progress that never falls."""
    past = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text").cast("long")).over(past).alias("tokens"), F.max(F.col("turn") % 4).over(past).alias("progress"))


@query("""select user_id, k, value, first_id as place from (select user_id, cast(json_extract_string(props, '$.k') as int) as k, value, event_id, min(event_id) over w as first_id, row_number() over (partition by user_id, cast(json_extract_string(props, '$.k') as int) order by event_id desc) as r
          from events window w as (partition by user_id, cast(json_extract_string(props, '$.k') as int))) where r = 1""")
def cache_upserts(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "value", "event_id")
    return joins.last_write_wins(rows, ["user_id", "k"], "event_id").select("user_id", "k", "value", "place")


@query("""select p_partkey as slot, case when p_size % 2 = 1 then 'start' when p_size % 10 = 0 then 'verify' else 'resume' end as action from part where p_partkey % 3 > 0
          union all select p_partkey, 'start' from part where p_partkey % 3 = 0""")
def checkpoint_resume(t: Tables) -> DataFrame:
    """Slots of a plan against a checkpoint: it counts only for the same request, and what it accepted is verified again."""
    plan = t.part.select(F.col("p_partkey").alias("slot"), (F.col("p_size") % 2).alias("request"))
    saved = t.part.filter("p_partkey % 3 > 0").select(F.col("p_partkey").alias("slot"), F.lit(0).alias("request"), (F.col("p_size") % 10 == 0).alias("accepted"))
    joined = plan.join(saved, ["slot", "request"], "left")
    return joined.select("slot", F.when(F.col("accepted").isNull(), "start").when(F.col("accepted"), "verify").otherwise("resume").alias("action"))


@query("""select id, row_number() over (order by case status when 'F' then 0 when 'P' then 1 else 2 end, day desc nulls first, id)::int as place from (select o_orderkey as id, o_orderstatus as status, case when o_orderkey % 9 > 0 then o_orderdate end as day from orders)
          order by case status when 'F' then 0 when 'P' then 1 else 2 end, day desc nulls first, id limit 40""")
def bucket_order(t: Tables) -> DataFrame:
    """A fixed order of states, then newest first with undated rows ahead."""
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate")).alias("day"))
    order = [F.when(F.col("status") == "F", 0).when(F.col("status") == "P", 1).otherwise(2), F.desc_nulls_first("day"), F.col("id")]
    return rows.orderBy(*order).limit(40).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "place")


@query("""select kind, id, seen from (select 'event' as kind, event_id as id, case when event_id % 5 > 0 then ts end as seen from events where user_id = 7 union all select 'order', o_orderkey, o_orderdate from orders where o_custkey = 7)
          order by coalesce(seen, timestamp '1970-01-01') desc, kind, id limit 200""")
def merged_history(t: Tables) -> DataFrame:
    """Two lists of one user, newest first; undated rows count as the oldest."""
    a = t.events.filter("user_id = 7").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 > 0, F.col("ts")).alias("seen"))
    b = t.orders.filter("o_custkey = 7").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen"))
    return a.unionByName(b).orderBy(F.coalesce("seen", F.expr("timestamp_ntz '1970-01-01'")).desc(), "kind", "id").limit(200)


@query("select distinct doc_id, source, ts as liked_at from documents join events on cast(json_extract_string(props, '$.k') as int) = doc_id where event_type = 'click'")
def distinct_wide(t: Tables) -> DataFrame:
    """The time of the like is part of the row, so several likers of one thing stay apart."""
    liked = t.events.filter("event_type = 'click'").select(F.get_json_object("props", "$.k").cast("int").alias("doc_id"), F.col("ts").alias("liked_at"))
    return t.documents.join(liked, "doc_id").select("doc_id", "source", "liked_at").distinct()


@query("""select o_orderkey as id from orders join customer on c_custkey = o_custkey where contains(lower(o_orderpriority), 'urgent') or contains(lower(c_name), '77') or contains(lower(c_mktsegment), 'auto')""")
def related_contains(t: Tables) -> DataFrame:
    """A search over a row's own and its user's columns."""
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    hit = F.lower("o_orderpriority").contains("urgent") | F.lower("c_name").contains("77") | F.lower("c_mktsegment").contains("auto")
    return joined.filter(hit).select(F.col("o_orderkey").alias("id"))


@query("""select c_custkey as user_id, last_sent from customer left join (select user_id, max(ts) as last_sent from events where event_type = 'signup' group by 1) on user_id = c_custkey
          where last_sent is null or last_sent < timestamp '2024-01-31' - interval 30 day""")
def inactive_alerts(t: Tables) -> DataFrame:
    sent = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("last_sent"))
    joined = users(t).select("user_id").join(sent, "user_id", "left")
    return joined.filter(F.col("last_sent").isNull() | (F.col("last_sent") < F.expr(f"{AS_OF} - interval 30 days")))


@query("""select event_id, cast(json_extract_string(props, '$.k') as int) < 30 as partial, epoch(timestamp '2024-01-31' - ts) < 86400 as fresh from events where json_extract_string(props, '$.k') is not null""")
def json_and_fresh(t: Tables) -> DataFrame:
    """A test on one field of a JSON column, and whether a cached row is younger than a day."""
    k = F.get_json_object("props", "$.k")
    age = (F.unix_micros(F.expr(AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return t.events.filter(k.isNotNull()).select("event_id", (k.cast("int") < 30).alias("partial"), (age < 86400).alias("fresh"))


@query("""select s_suppkey as id, s_acctbal >= 0 and list_contains(['a', 'b'], ['a', 'c'][s_suppkey % 2 + 1]) as visible, s_suppkey % 4 > 0 or s_acctbal < 0 as unhealthy from supplier""")
def gates(t: Tables) -> DataFrame:
    """Shown if active and of one's groups; unhealthy if it failed or holds an error."""
    needed = F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("c")
    failures, error = F.col("s_suppkey") % 4, F.when(F.col("s_acctbal") < 0, F.lit("overdrawn"))
    shown = (F.col("s_acctbal") >= 0) & F.array_contains(F.array(F.lit("a"), F.lit("b")), needed)
    return t.supplier.select(F.col("s_suppkey").alias("id"), shown.alias("visible"), ((failures > 0) | error.isNotNull()).alias("unhealthy"))


@query("""select min(doc_id) as id, lot from (select doc_id, nullif(trim(substr(text, 1, 6)), '') as lot, text from documents) where lot is not null and (contains(lower(text), 'the ') or contains(lower(text), 'de ')) group by lot""")
def scraped_rows(t: Tables) -> DataFrame:
    """Rows with a lot number and one of the keywords, each lot as first seen."""
    lot = F.nullif(F.trim(F.substring("text", 1, 6)), F.lit(""))
    low = F.lower("text")
    rows = t.documents.withColumn("lot", lot).filter(F.col("lot").isNotNull() & (low.contains("the ") | low.contains("de ")))
    return rows.groupBy("lot").agg(F.min("doc_id").alias("id")).select("id", "lot")


@query("""select p_partkey as id, 'Brand ' || replace(p_brand, 'Brand#', '') || ' ' || p_type as q, cast(floor(p_size * 100 / 50) as int) as done, case when p_partkey % 2 = 0 and p_partkey > 0 then p_partkey end as whole,
          case when ceil(p_size / 60.0) = 1 then '1 minute' else cast(cast(ceil(p_size / 60.0) as bigint) as varchar) || ' minutes' end as wait from part""")
def small_forms(t: Tables) -> DataFrame:
    """Filled templates, percent, whole numbers from text and waiting times."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit("x")))
    q = evidence.filled("Brand {brand}  {kind}", {"brand": F.replace("p_brand", F.lit("Brand#"), F.lit("")), "kind": F.col("p_type")})
    return t.part.select(F.col("p_partkey").alias("id"), q.alias("q"), evidence.percent(F.col("p_size"), F.lit(50)).alias("done"), evidence.positive_id(raw).alias("whole"), evidence.minutes_left(F.col("p_size")).alias("wait"))


@query("""with d as (select o_orderkey as id, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 40 as int) as b from orders)
          select id, case when a = b then strftime(a, '%-d %b %Y') when date_trunc('month', a) = date_trunc('month', b) then strftime(a, '%-d') || '-' || strftime(b, '%-d %b %Y') else strftime(a, '%-d %b %Y') || ' - ' || strftime(b, '%-d %b %Y') end as shown from d""")
def day_ranges(t: Tables) -> DataFrame:
    a = F.col("o_orderdate").cast("date")
    return t.orders.select(F.col("o_orderkey").alias("id"), evidence.day_range(a, F.date_add(a, (F.col("o_orderkey") % 40).cast("int"))).alias("shown"))


_FOUND_SQL = """
    found as (select 's' || (user_id % 12) as source, cast(ts as date) as run, event_id as place, (cast(json_extract_string(props, '$.k') as int) * 7 + user_id)::varchar as lot_id, event_type <> 'error' as fetched, event_type <> 'signup' as fits from events),
    flags as (select *, case source when 's11' then null else source not in ('s3', 's7') end as active, substr(lot_id, 1, 1) = '9' as old from found),
    marked as (select *, coalesce(max((coalesce(active, false) and not old and fetched and fits)::int) over (partition by source, lot_id order by run, place rows between unbounded preceding and 1 preceding), 0) = 1 as made from flags),
    judged as (select *, case when active is null then 'no-source' when not active then 'inactive' when old or made then 'existing' when not fetched then 'failed' when not fits then 'filtered' else 'created' end as outcome from marked),
    log as (select source, run, case when count(*) filter (outcome = 'failed') > 0 then 'partial' else 'success' end as status, count(*) as found, count(*) filter (outcome <> 'failed') as done, count(*) filter (outcome = 'failed') as failed,
                   count(*) filter (outcome = 'created') as created, string_agg('Tender ' || lot_id || ': Failed to fetch tender detail', chr(10) order by place) filter (outcome = 'failed') as error from judged where active group by 1, 2)"""


def _scraped(t: Tables) -> DataFrame:
    """Events as tenders that sources list day by day; lots whose number begins with 9 are stored before."""
    lot = (F.get_json_object("props", "$.k").cast("int") * 7 + F.col("user_id")).cast("string")
    kind = F.col("event_type")
    found = t.events.select(F.concat(F.lit("s"), (F.col("user_id") % 12).cast("string")).alias("source"), F.col("ts").cast("date").alias("run"), F.col("event_id").alias("place"), lot.alias("lot_id"), (kind != "error").alias("fetched"), (kind != "signup").alias("fits"))
    known = found.select("source").distinct().filter("source != 's11'").withColumn("is_active", ~F.col("source").isin("s3", "s7"))
    return scraping.outcomes(found, known, found.filter(F.col("lot_id").startswith("9")).select("source", "lot_id"))


@query(f"with {_FOUND_SQL} select place as event_id, outcome from judged")
def scrape_outcomes(t: Tables) -> DataFrame:
    """What becomes of each listed tender."""
    return _scraped(t).select(F.col("place").alias("event_id"), "outcome")


@query(f"with {_FOUND_SQL} select * from log")
def scrape_log(t: Tables) -> DataFrame:
    """The log of each source's daily runs, with the lots that failed."""
    return scraping.run_log(_scraped(t))


@query(f"with {_FOUND_SQL} select source, count(*) as total_scrapes, count(*) filter (status = 'success') as successful_scrapes, count(*) filter (status <> 'success') as failed_scrapes, max(run) as last_run, arg_max(status, run) as last_status from log group by 1")
def scrape_counters(t: Tables) -> DataFrame:
    return scraping.counters(scraping.run_log(_scraped(t)))
