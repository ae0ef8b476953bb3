"""Queues, limits, likes and alerts as transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates, numbers
from tessera.operators import alerts, limits, listing, queues
from tessera.plans.registry import AS_OF, Tables, query

_T0 = "timestamp '1998-08-01'"
_JOBS = f"""(select o_orderkey as id, case o_orderstatus when 'O' then 'queued' when 'P' then 'processing' else 'done' end as status, 6 - cast(substr(o_orderpriority, 1, 1) as int) as priority,
            o_orderdate as available_at, o_orderdate as created_at, cast(o_orderkey % 4 as int) as attempts, 3 as max_attempts,
            case when o_orderstatus = 'P' then 'w' || (o_orderkey % 3) end as owner, case when o_orderstatus = 'P' then o_orderdate + interval 90 second end as lease_until,
            o_orderkey % 11 = 0 as cancel_requested, cast(null as timestamp) as finished_at from orders)"""
_EXPIRED = f"(status = 'processing' and lease_until <= {_T0})"
_CLAIMABLE = f"((status = 'queued' and available_at <= {_T0}) or {_EXPIRED}) and attempts < max_attempts and not cancel_requested"


def t0() -> F.Column:
    return F.expr("timestamp_ntz '1998-08-01'")


def jobs(t: Tables) -> DataFrame:
    running = F.col("o_orderstatus") == "P"
    none = F.lit(None).cast("timestamp_ntz")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(running, "processing").otherwise("done").alias("status"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("available_at"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"),
        F.when(running, F.concat(F.lit("w"), (F.col("o_orderkey") % 3).cast("string"))).alias("owner"),
        F.when(running, F.col("o_orderdate") + F.expr("interval 90 seconds")).alias("lease_until"),
        (F.col("o_orderkey") % 11 == 0).alias("cancel_requested"), none.alias("finished_at"),
    )


@query(f"""with p as (select id from {_JOBS} where {_CLAIMABLE} order by priority desc, available_at, created_at, id limit 20)
          select j.id, case when p.id is not null then 'processing' else status end as status, attempts + (p.id is not null)::int as attempts, case when p.id is not null then 'w9' else owner end as owner,
                 case when p.id is not null then {_T0} + interval 90 second else lease_until end as lease_until from {_JOBS} j left join p on p.id = j.id""")
def queue_claim(t: Tables) -> DataFrame:
    return queues.claim(jobs(t), t0(), "w9", 20).select("id", "status", "attempts", "owner", "lease_until")


@query(f"""with e as (select *, case when cancel_requested and (status = 'queued' or {_EXPIRED}) then 'cancelled' when {_EXPIRED} and attempts >= max_attempts then 'failed' end as ended from {_JOBS})
          select id, coalesce(ended, status) as status, case when ended is null then owner end as owner, case when ended is not null then {_T0} end as finished_at from e""")
def queue_reap(t: Tables) -> DataFrame:
    return queues.reap(jobs(t), t0()).select("id", "status", "owner", "finished_at")


@query("""with j as (select o_orderkey as id, 'processing' as status, cast(o_orderkey % 4 as int) as attempts, o_orderkey % 11 = 0 as cancel_requested, o_orderkey % 2 = 0 as by_owner,
                 case o_orderkey % 5 when 0 then 'complete' when 1 then 'fail' when 2 then 'heartbeat' when 3 then 'cancel' end as op from orders where o_orderstatus = 'P'),
          s as (select *, op = 'fail' and by_owner and attempts < 3 and not cancel_requested as retry from j)
          select id, case when op = 'complete' and by_owner then 'done' when op = 'fail' and by_owner and cancel_requested then 'cancelled' when retry then 'queued' when op = 'fail' and by_owner then 'failed' else status end as status,
                 cancel_requested or coalesce(op = 'cancel', false) as cancel_requested,
                 case when retry then timestamp '1998-08-01' + to_milliseconds(1000 * least(300, 5 * 2 ** (attempts - 1))) else timestamp '1998-01-01' end as available_at from s""")
def queue_fail_backoff(t: Tables) -> DataFrame:
    own = jobs(t).filter("status = 'processing'").withColumns({"owner": F.lit("w1"), "lease_until": t0() + F.expr("interval 1 hour"), "available_at": F.expr("timestamp_ntz '1998-01-01'")})
    op = F.element_at(F.array(F.lit("complete"), F.lit("fail"), F.lit("heartbeat"), F.lit("cancel"), F.lit(None)), (F.col("id") % 5 + 1).cast("int"))
    events = own.select("id", op.alias("op"), F.when(F.col("id") % 2 == 0, "w1").otherwise("w2").alias("by")).filter("op is not null")
    return queues.apply_events(own, events, t0()).select("id", "status", "cancel_requested", "available_at")


@query(f"""select cast(l_orderkey as varchar) as task_id, case when j.status = 'done' then 'done' else 'processing' end as status from (select distinct l_orderkey from lineitem) join {_JOBS} j on j.id = l_orderkey""")
def queue_reconcile(t: Tables) -> DataFrame:
    domain = t.lineitem.select(F.col("l_orderkey").cast("string").alias("task_id"), F.lit("processing").alias("status")).distinct()
    return queues.mirrored(domain, jobs(t)).select("task_id", "status")


@query(f"select o_orderkey as id from orders where o_custkey % 3 = 0 and o_custkey not in (select o_custkey from orders where o_orderstatus = 'F') qualify row_number() over (partition by o_custkey order by o_orderkey) = 1")
def queue_enqueue(t: Tables) -> DataFrame:
    there = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("idempotency_key"))
    new = t.orders.filter("o_custkey % 3 = 0").groupBy(F.col("o_custkey").alias("idempotency_key")).agg(F.min("o_orderkey").alias("id"))
    return queues.enqueue(there, new).filter("id is not null").select("id")


@query(f"select count(*) filter (where o_orderdate < {_T0} - interval 35 day) as deleted from orders")
def queue_sweep(t: Tables) -> DataFrame:
    return queues.swept(t.orders, "o_orderdate", t0(), 35)[1]


@query("select event_id, row_number() over (partition by event_type, date_trunc('minute', ts) order by ts, event_id) <= 1 and row_number() over (partition by event_type, date_trunc('day', ts) order by ts, event_id) <= 50 as allowed from events")
def rate_limit_minute(t: Tables) -> DataFrame:
    order = [F.col("ts"), F.col("event_id")]
    minute = limits.window_limit(t.events, ["event_type"], "ts", "minute", 1, order, "per_minute")
    both = limits.window_limit(minute, ["event_type"], "ts", "day", 50, order, "per_day")
    return both.select("event_id", (F.col("per_minute") & F.col("per_day")).alias("allowed"))


@query("""select event_id, sum(cast(value as decimal(18,4))) over (partition by user_id, date_trunc('day', ts) order by ts, event_id rows between unbounded preceding and current row) <= 100 as within_budget from events""")
def rate_limit_budget(t: Tables) -> DataFrame:
    found = limits.budget_limit(t.events, ["user_id"], "ts", "day", "value", 100, [F.col("ts"), F.col("event_id")])
    return found.select("event_id", "within_budget")


@query("""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as i from events where event_type = 'error'),
          f as (select user_id, event_id, ts, i, ts as first, 1 as n from e where i = 1
                union all select e.user_id, e.event_id, e.ts, e.i, case when e.ts - f.first >= interval 5 day then e.ts else f.first end, case when e.ts - f.first >= interval 5 day then 1 else f.n + 1 end
                from f join e on e.user_id = f.user_id and e.i = f.i + 1)
          select event_id, n as attempt, n >= 3 as locked from f""")
def lockout_fold(t: Tables) -> DataFrame:
    errors = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts")
    return limits.lockout(errors, most=3, seconds=5 * 86400).select(F.col("id").alias("event_id"), "attempt", "locked")


@query("""select user_id, k as content_id, ts as liked_at from (select user_id, cast(json_extract_string(props, '$.k') as int) as k, ts, event_type,
          row_number() over (partition by user_id, cast(json_extract_string(props, '$.k') as int) order by ts desc, event_id desc) as r from events where event_type in ('click', 'view')) where r = 1 and event_type = 'click'""")
def like_toggle_latest(t: Tables) -> DataFrame:
    """A click likes, a view takes it back: the last one of a user and content decides."""
    log = t.events.filter("event_type in ('click', 'view')").withColumn("content_id", F.get_json_object("props", "$.k").cast("int"))
    last = listing.latest(log, ["user_id", "content_id"], [F.desc("ts"), F.desc("event_id")])
    return last.filter("event_type = 'click'").select("user_id", "content_id", F.col("ts").alias("liked_at"))


@query("""with s as (select l_suppkey as id, l_shipdate as a, l_shipdate + to_days(cast(l_quantity % 20 as int) + 1) as b from lineitem),
          g as (select *, coalesce(a > max(b) over (partition by id order by a, b rows between unbounded preceding and 1 preceding), true)::int as new from s),
          i as (select *, sum(new) over (partition by id order by a, b rows between unbounded preceding and current row) as island from g)
          select id, sum(epoch(e - s))::double as active_seconds, count(*) as islands from (select id, island, min(a) as s, max(b) as e from i group by 1, 2) group by 1""")
def active_time_union(t: Tables) -> DataFrame:
    days = F.expr("make_dt_interval(cast(l_quantity % 20 as int) + 1)")
    spans = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + days).alias("b"))
    return limits.active_seconds(spans, "id", "a", "b")


_PREFS = """(select c_custkey as user_id, ['Asia/Dubai', 'Europe/Paris', 'America/New_York', null][c_custkey % 4 + 1] as timezone, c_custkey % 24 as digest_hour, ['monday', 'wednesday', null][c_custkey % 3 + 1] as digest_day,
             case when c_custkey % 2 = 0 then 'weekly' else 'daily' end as frequency, c_custkey % 7 <> 0 as active, c_acctbal > 0 as enabled,
             case when c_custkey % 5 <> 0 then timestamp '2024-01-31' - to_hours(cast(c_custkey % 300 as int)) end as last_sent from customer)"""


def preferences(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("c_custkey") % n + 1).cast("int"))
    now = F.expr(AS_OF)
    return t.customer.select(
        F.col("c_custkey").alias("user_id"), pick(["Asia/Dubai", "Europe/Paris", "America/New_York", None], 4).alias("timezone"), (F.col("c_custkey") % 24).cast("int").alias("digest_hour"),
        pick(["monday", "wednesday", None], 3).alias("digest_day"), F.when(F.col("c_custkey") % 2 == 0, "weekly").otherwise("daily").alias("frequency"),
        (F.col("c_custkey") % 7 != 0).alias("active"), (F.col("c_acctbal") > 0).alias("enabled"),
        F.when(F.col("c_custkey") % 5 != 0, now - F.expr("make_dt_interval(0, cast(c_custkey % 300 as int))")).alias("last_sent"),
    )


@query(f"""with p as (select *, (timestamp '2024-01-31' at time zone 'UTC') at time zone coalesce(timezone, 'Asia/Dubai') as here, case when coalesce(digest_hour, 0) = 0 then 9 else digest_hour end as h from {_PREFS})
          select user_id, frequency from p where active and enabled and hour(here) = h and (frequency <> 'weekly' or lower(dayname(here)) = coalesce(digest_day, 'monday'))
                 and (last_sent is null or last_sent < timestamp '2024-01-31' - case when frequency = 'weekly' then interval 6 day else interval 20 hour end)""")
def alerts_due(t: Tables) -> DataFrame:
    return alerts.due(preferences(t), F.expr(AS_OF)).select("user_id", "frequency")


@query("""with p as (select c_custkey as user_id, 'src' || (c_custkey % 20) as source, case when c_custkey % 3 = 0 then [] else ['THE', 'de'] end as keywords from customer),
          c as (select doc_id as content_id, source, substr(text, 1, 60) as title, timestamp '2024-01-31' - to_hours(cast(doc_id % 72 as int)) as created_at from documents),
          m as (select p.user_id, p.source, content_id, created_at from p join c using (source) where created_at > timestamp '2024-01-31' - interval 1 day
                and (len(keywords) = 0 or len(list_filter(keywords, lambda k: contains(lower(title), lower(k)))) > 0)
                and not exists (select 1 from events e where e.event_type = 'purchase' and e.user_id = p.user_id and cast(json_extract_string(props, '$.k') as int) = content_id))
          select user_id, content_id, rank::int as rank from (select *, row_number() over (partition by user_id, source order by created_at desc, content_id) as rank from m) where rank <= 5""")
def alerts_new_content(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    words = F.when(F.col("c_custkey") % 3 == 0, none).otherwise(F.array(F.lit("THE"), F.lit("de")))
    prefs = t.customer.select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")).alias("source"), words.alias("keywords"))
    made = F.expr(f"{AS_OF} - make_dt_interval(0, cast(doc_id % 72 as int))")
    content = t.documents.select(F.col("doc_id").alias("content_id"), "source", F.substring("text", 1, 60).alias("title"), made.alias("created_at"))
    sent = t.events.filter("event_type = 'purchase'").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("content_id"))
    return alerts.new_content(prefs, content, sent, F.expr(AS_OF), "1 day", 5)


@query(f"select frequency, count(*) as n from (select frequency, last_sent + interval 1 day as next_send_at from {_PREFS}) where frequency in ('daily', 'weekly') and next_send_at < timestamp '2024-01-31' - interval 1 day group by 1")
def alerts_stuck(t: Tables) -> DataFrame:
    prefs = preferences(t).withColumn("next_send_at", F.col("last_sent") + F.expr("interval 1 day"))
    return alerts.stuck(prefs, F.expr(AS_OF)).groupBy("frequency").agg(F.count("*").alias("n"))


@query("""select o_orderkey as id, round(case o_orderstatus when 'O' then o_totalprice / 1.0 when 'F' then o_totalprice / 470.17::double else o_totalprice / 11970.68::double end, 2) as dollars from orders""")
def usd_amounts(t: Tables) -> DataFrame:
    code = F.when(F.col("o_orderstatus") == "O", "USD").when(F.col("o_orderstatus") == "F", "KZT").otherwise("UZS")
    return t.orders.select(F.col("o_orderkey").alias("id"), numbers.in_dollars(F.col("o_totalprice"), code).alias("dollars"))


@query("select role, round(sum(length(text)) / 1e6 * 0.15 + count(*) / 1e6 * 0.60, 6) as cost from conversations group by 1")
def llm_cost(t: Tables) -> DataFrame:
    cost = numbers.token_cost(F.sum(F.length("text")), F.count("*"))
    return t.conversations.groupBy("role").agg(F.round(cost, 6).alias("cost"))


@query("""with h as (select o_orderkey as id, (epoch_us(o_orderdate) - epoch_us(timestamp '1998-08-01 06:30:00')) / 1e6 / 3600 as h from orders)
          select id, case when h < 0 then 'past' when h < 12 then 'Today' when h < 24 then cast(floor(h) as bigint) || 'h left' when h < 72 then 'soon' when h < 168 then 'week' else 'later' end as bucket from h""")
def deadline_bucket(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), dates.deadline_bucket(F.col("o_orderdate"), F.expr("timestamp_ntz '1998-08-01 06:30:00'")).alias("bucket"))


@query("""select event_id, least(300.0, 5.0 * 2 ** (event_id % 9 - 1))::double as retry_s, least(10000.0, 1800.0 * 2 ** least(event_id % 9, 3))::double as poll_ms,
          cast(greatest(0, least(100, round(case when value > 0 and value <= 1 then value * 100 else value end))) as int) as confidence from events""")
def delays_and_confidence(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 9).cast("int")
    return t.events.select("event_id", numbers.backoff(n).alias("retry_s"), numbers.poll_delay(n).alias("poll_ms"), numbers.confidence(F.col("value")).alias("confidence"))
