"""Lists, joins and aggregates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import dates, numbers, text
from tessera.operators import engagement, listing
from tessera.plans.registry import AS_OF, Tables, query

_LIKES = "(select user_id, ts as created_at, event_id, cast(json_extract_string(props, '$.k') as int) as content_id from events where event_type = 'click')"


def now() -> F.Column:
    return F.expr(AS_OF)


def likes(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.filter("event_type = 'click'").select("user_id", F.col("ts").alias("created_at"), "event_id", k.alias("content_id"))


def users(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("team"))


def money(column: str) -> F.Column:
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


@query("""select e.user_id, coalesce(c.c_name, 'Unknown') as name, coalesce(c.c_mktsegment, 'Unknown') as team, activity_count
          from (select user_id, count(*) as activity_count from events where ts > timestamp '2024-01-31' - interval 7 day group by 1 order by 2 desc, 1 limit 10) e
          left join customer c on c.c_custkey = e.user_id""")
def top_active_users(t: Tables) -> DataFrame:
    return engagement.top_users(engagement.since(t.events, "ts", now(), "7 days"), users(t), 10)


@query("select cast(ts as date) as day, event_type, count(*) as n from events group by all")
def activity_by_day(t: Tables) -> DataFrame:
    return engagement.daily(t.events, "ts", "event_type")


@query("""select date_trunc('hour', ts) as hour, event_type <> 'error' as success, count(*) as n from events
          where ts > timestamp '2024-01-31' - interval 3 day group by all""")
def activity_by_hour_status(t: Tables) -> DataFrame:
    recent = engagement.since(t.events, "ts", now(), "3 days").withColumn("success", F.col("event_type") != "error")
    return engagement.hourly(recent, "ts", "success")


@query("""select count(distinct id) as active_users from (select user_id as id from events where ts > timestamp '2024-01-31' - interval 7 day
          union select o_custkey from orders where o_orderdate > timestamp '2001-01-01')""")
def active_users_union(t: Tables) -> DataFrame:
    a = engagement.since(t.events, "ts", now(), "7 days").select(F.col("user_id").alias("id"))
    b = t.orders.filter("o_orderdate > timestamp_ntz '2001-01-01'").select(F.col("o_custkey").alias("id"))
    return a.union(b).agg(F.countDistinct("id").alias("active_users"))


@query(f"select content_id, count(*) as n_likes, count(distinct user_id) as likers from {_LIKES} where content_id in (1, 2, 3, 5, 8, 13, 21) group by 1")
def likes_by_content(t: Tables) -> DataFrame:
    return likes(t).filter(F.col("content_id").isin(1, 2, 3, 5, 8, 13, 21)).groupBy("content_id").agg(F.count("*").alias("n_likes"), F.countDistinct("user_id").alias("likers"))


@query(f"select distinct content_id from {_LIKES} where user_id = 7 and content_id in (select doc_id from documents)")
def user_liked_set(t: Tables) -> DataFrame:
    own = likes(t).filter("user_id = 7").join(t.documents, F.col("content_id") == F.col("doc_id"), "left_semi")
    return own.select("content_id").distinct()


@query(f"""select user_id, c_name as name, created_at from (select user_id, created_at, row_number() over (partition by user_id order by created_at desc, event_id desc) as r
          from {_LIKES}) join customer on c_custkey = user_id where r = 1""")
def likers_latest(t: Tables) -> DataFrame:
    last = listing.latest(likes(t), ["user_id"], [F.desc("created_at"), F.desc("event_id")])
    return last.join(users(t), "user_id").select("user_id", "name", "created_at")


@query("select coalesce(nullif(c_mktsegment, 'BUILDING'), 'No Team') as team, count(*) as n from customer group by 1")
def users_by_team(t: Tables) -> DataFrame:
    team = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("No Team"))
    return t.customer.groupBy(team.alias("team")).agg(F.count("*").alias("n"))


@query(f"""select team, members, likes, activity, round(likes / members, 2) as likes_per_user, round(activity / members, 2) as activity_per_user,
                 round((0.6::double * likes / members + 0.4::double * activity / members) * 100, 2) as score
          from (select c_mktsegment as team, count(*) as members, coalesce(sum(l.n), 0)::bigint as likes, coalesce(sum(a.n), 0)::bigint as activity
                from customer c left join (select user_id, count(*) as n from {_LIKES} group by 1) l on l.user_id = c_custkey
                     left join (select user_id, count(*) as n from events group by 1) a on a.user_id = c_custkey group by 1)""")
def team_engagement(t: Tables) -> DataFrame:
    return engagement.team_engagement(users(t), likes(t), t.events)


@query(f"""select doc_id as content_id, substr(text, 1, 80) as title, coalesce(l.n, 0) as likes, last_liked from documents
          left join (select content_id, count(*) as n, max(created_at) as last_liked from {_LIKES} group by 1) l on content_id = doc_id
          order by likes desc, doc_id limit 20""")
def content_top_liked(t: Tables) -> DataFrame:
    content = t.documents.select(F.col("doc_id").alias("content_id"), F.substring("text", 1, 80).alias("title"))
    return engagement.most_liked(content, likes(t), 20)


@query(f"select source, count(*) as article_count, count(distinct user_id) as likers from documents join {_LIKES} on content_id = doc_id group by 1")
def source_leaderboard(t: Tables) -> DataFrame:
    return engagement.source_leaderboard(t.documents.withColumnRenamed("doc_id", "content_id"), likes(t))


@query(f"""select content_id, count(*) as likes, max(created_at) as last_liked from {_LIKES}
          group by 1 having max(created_at) > timestamp '2024-01-15' order by last_liked desc, content_id limit 10""")
def community_feed_recent(t: Tables) -> DataFrame:
    feed = likes(t).groupBy("content_id").agg(F.count("*").alias("likes"), F.max("created_at").alias("last_liked"))
    return feed.filter("last_liked > timestamp_ntz '2024-01-15'").orderBy(F.desc("last_liked"), "content_id").limit(10)


@query(f"select content_id, count(*) as likes, count(*) filter (where user_id = 7) as mine from {_LIKES} group by 1 order by likes desc, content_id limit 10")
def community_feed_top(t: Tables) -> DataFrame:
    feed = likes(t).groupBy("content_id").agg(F.count("*").alias("likes"), F.count_if(F.col("user_id") == 7).alias("mine"))
    return feed.orderBy(F.desc("likes"), "content_id").limit(10)


@query(f"""with w as (select * from {_LIKES} where created_at >= timestamp '2024-01-22' and created_at < timestamp '2024-01-29'),
          c as (select 'article' as kind, doc_id as id, substr(text, 1, 40) as title from documents where doc_id % 2 = 0
                union all select 'publication', doc_id, substr(text, 1, 40) from documents where doc_id % 2 = 1
                union all select 'part', p_partkey, p_name from part)
          select kind, id, title, n from (select kind, id, title, count(*) as n, row_number() over (partition by kind order by count(*) desc, id) as r
          from c join w on content_id = id group by 1, 2, 3) where r <= 5""")
def weekly_digest(t: Tables) -> DataFrame:
    monday, sunday = dates.previous_week(now())
    week = likes(t).filter((F.col("created_at") >= monday.cast("timestamp_ntz")) & (F.col("created_at") < F.date_add(sunday, 1).cast("timestamp_ntz")))
    kind = F.when(F.col("doc_id") % 2 == 0, "article").otherwise("publication")
    docs = t.documents.select(kind.alias("kind"), F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("title"))
    parts = t.part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    counts = week.groupBy("content_id").agg(F.count("*").alias("n"))
    liked = docs.unionByName(parts).join(counts, F.col("content_id") == F.col("id"))
    return listing.top_per_group(liked, ["kind"], [F.desc("n"), F.col("id")], 5).select("kind", "id", "title", "n")


@query("select cast(ts as date) as day, event_type, count(*) as n from events where user_id is not null group by all")
def merge_two_domains_daily(t: Tables) -> DataFrame:
    odd = F.col("user_id") % 2 == 1
    return engagement.merged_counts([engagement.daily(t.events.filter(d), "ts", "event_type") for d in (odd, ~odd)], ["day", "event_type"])


@query("""select count(distinct conv_id) as sessions, count(*) as messages, count(*) filter (where role = 'user') as user_messages,
          count(distinct conv_id) filter (where role = 'system') as with_system, round(count(*) / count(distinct conv_id), 2) as per_session from conversations""")
def assistant_overview(t: Tables) -> DataFrame:
    found = t.conversations.agg(
        F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"),
        F.countDistinct(F.when(F.col("role") == "system", F.col("conv_id"))).alias("with_system"),
    )
    return found.withColumn("per_session", numbers.ratio(F.col("messages"), F.col("sessions")))


@query("""select c.conv_id % 5 as bucket, count(*) as messages, sum(c.turns)::bigint as turns_over_messages, max(turns)::bigint as most_turns
          from (select conv_id, count(*) as turns from conversations group by 1) c left join conversations m on m.conv_id = c.conv_id group by 1""")
def assistant_fanout(t: Tables) -> DataFrame:
    """A conversation's turns are summed once a message, as the joined rows have them."""
    sessions = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    joined = sessions.join(t.conversations.select("conv_id", "turn"), "conv_id", "left")
    return joined.groupBy((F.col("conv_id") % 5).alias("bucket")).agg(F.count("*").alias("messages"), F.sum("turns").alias("turns_over_messages"), F.max("turns").alias("most_turns"))


@query("""select conv_id % 5 as bucket, sum(turns)::bigint as turns from (select conv_id, count(*) as turns from conversations group by 1) group by 1""")
def assistant_fanout_fixed(t: Tables) -> DataFrame:
    sessions = t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return sessions.groupBy((F.col("conv_id") % 5).alias("bucket")).agg(F.sum("turns").alias("turns"))


@query("""select event_type as tool, count(*) as calls, count(*) filter (where value >= 50) as success, count(*) filter (where value < 50) as failed, cast(round(sum(cast(value as decimal(18,2)))::double / count(*)) as bigint) as mean_ms
          from events group by 1 order by calls desc, tool limit 10""")
def assistant_top_tools(t: Tables) -> DataFrame:
    ok = F.col("value") >= 50
    tools = t.events.groupBy(F.col("event_type").alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.round(money("value") / F.count("*")).cast("long").alias("mean_ms")
    )
    return tools.orderBy(F.desc("calls"), "tool").limit(10)


@query("select cast(ts as date) as day, count(distinct user_id) as sessions, count(*) as messages from events group by 1 order by 1 desc limit 7")
def assistant_daily_trend(t: Tables) -> DataFrame:
    days = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.countDistinct("user_id").alias("sessions"), F.count("*").alias("messages"))
    return days.orderBy(F.desc("day")).limit(7)


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as message_index, (max(turn) over (partition by conv_id)) + 1 as next_index from conversations")
def message_sequence(t: Tables) -> DataFrame:
    own = Window.partitionBy("conv_id")
    index = (F.row_number().over(own.orderBy("turn")) - 1).cast("long")
    return t.conversations.select("conv_id", "turn", index.alias("message_index"), (F.coalesce(F.max("turn").over(own), F.lit(-1)) + 1).alias("next_index"))


_TENDERS = """(select o_orderkey as id, o_totalprice as total, o_orderdate as published, o_orderdate + interval 30 day as deadline, c_name as buyer,
             [o_orderstatus, substr(o_orderpriority, 1, 1)] as groups, o_orderstatus as status from orders join customer on c_custkey = o_custkey)"""


def tenders(t: Tables) -> DataFrame:
    deadline = F.when(F.col("o_orderkey").isNotNull(), F.col("o_orderdate") + F.expr("interval 30 days"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("published"), deadline.alias("deadline"), F.col("c_name").alias("buyer"),
        F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("groups"), F.col("o_orderstatus").alias("status"),
    )


SORTS = {
    "newest": (lambda: [F.desc_nulls_last("published"), F.desc("id")], "published desc nulls last, id desc"),
    "deadline": (lambda: [F.asc_nulls_last("deadline"), F.asc("id")], "deadline asc nulls last, id"),
    "value_desc": (lambda: [F.desc_nulls_last("total"), F.desc("id")], "total desc nulls last, id desc"),
    "value_asc": (lambda: [F.asc_nulls_last("total"), F.asc("id")], "total asc nulls last, id"),
}


def _tender_list(sort: str) -> None:
    order, sql = SORTS[sort]

    @query(
        f"select id, buyer, total, published from {_TENDERS} where buyer ilike '%Customer%1%' and status in ('O', 'F') and total >= 1000 order by {sql} limit 25 offset 25",
        name=f"tender_list_{sort}",
    )
    def tender_list(t: Tables) -> DataFrame:
        found = listing.where(tenders(t), search="Customer%1", search_in=["buyer"], among={"status": ["O", "F"]}, at_least={"total": 1000})
        return listing.page(found, order(), number=2, size=25).select("id", "buyer", "total", "published")


for _sort in SORTS:
    _tender_list(_sort)


@query(f"select status, count(*) as n from {_TENDERS} where len(groups) > 0 and list_contains(groups, 'O') and list_contains(groups, '1') group by 1")
def tender_filters_arrays(t: Tables) -> DataFrame:
    found = listing.where(tenders(t).filter(F.size("groups") > 0), has_all={"groups": ["O", "1"]})
    return found.groupBy("status").agg(F.count("*").alias("n"))


@query("""select o_orderkey as id, count(l_orderkey) as lots, coalesce(sum(cast(l_extendedprice as decimal(18,2)))::double, 0) as lot_total, coalesce(max(l_linenumber), 0) as last_lot
          from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def tender_detail_nested(t: Tables) -> DataFrame:
    """Orders with what their lots amount to; the lots themselves are only listed where they are shown."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    lots = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("lots"), F.sum(price).alias("lot_total"), F.max("l_linenumber").alias("last_lot"))
    joined = t.orders.select(F.col("o_orderkey").alias("id")).join(lots, "id", "left")
    zero = F.lit(0)
    return joined.select("id", F.coalesce("lots", zero.cast("long")).alias("lots"), F.coalesce(F.col("lot_total").cast("double"), F.lit(0.0)).alias("lot_total"), F.coalesce("last_lot", zero).alias("last_lot"))


@query(f"select id, published from {_TENDERS} where buyer = (select c_name from customer where c_custkey = 7) and id <> 33 order by published desc nulls last, id desc limit 10")
def related_tenders(t: Tables) -> DataFrame:
    buyer = t.customer.filter("c_custkey = 7").select(F.col("c_name").alias("buyer"))
    found = tenders(t).join(buyer, "buyer", "left_semi").filter("id <> 33")
    return listing.page(found, SORTS["newest"][0](), 1, 10).select("id", "published")


@query(f"select id, published from {_TENDERS} where published < timestamp '2000-06-01' or (published = timestamp '2000-06-01' and id < 500) order by published desc, id desc limit 21")
def keyset_page(t: Tables) -> DataFrame:
    position = listing.read_cursor(listing.cursor_of(datetime(2000, 6, 1), 500))
    return listing.after_cursor(tenders(t), "published", "id", position, 20).select("id", "published")


_CALENDAR = "(select o_orderkey as id, cast(o_orderdate as date) as start_date, case when o_orderkey % 3 = 0 then null else cast(o_orderdate as date) + cast(o_orderkey % 5 as int) end as end_date from orders)"


def calendar_events(t: Tables) -> DataFrame:
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 3 != 0, F.date_add(start, (F.col("o_orderkey") % 5).cast("int")))
    return t.orders.select(F.col("o_orderkey").alias("id"), start.alias("start_date"), end.alias("end_date"))


_DAY = date(1998, 8, 12)
_BOUNDS = {
    "past": "coalesce(start_date, end_date) <= date '1998-08-11'",
    "upcoming": "coalesce(end_date, start_date) >= date '1998-08-12'",
    "week": "coalesce(end_date, start_date) >= date '1998-08-12' and coalesce(start_date, end_date) <= date '1998-08-16'",
    "month": "coalesce(end_date, start_date) >= date '1998-08-12' and coalesce(start_date, end_date) <= date '1998-08-31'",
}


def _event_range(name: str) -> None:
    @query(f"select count(*) as n, min(start_date) as first_start, max(id) as last_id from {_CALENDAR} where {_BOUNDS[name]}", name=f"event_range_{name}")
    def event_range(t: Tables) -> DataFrame:
        bounds = dates.named_range({"week": "this-week", "month": "this-month"}.get(name, name), _DAY)
        found = calendar_events(t).filter(dates.overlaps(F.col("start_date"), F.col("end_date"), bounds))
        return found.agg(F.count("*").alias("n"), F.min("start_date").alias("first_start"), F.max("id").alias("last_id"))


for _name in _BOUNDS:
    _event_range(_name)


@query("""select count(*) filter (where o_orderstatus = 'F') as sent, count(*) filter (where o_orderstatus = 'O') as queued, count(*) filter (where o_orderstatus = 'P') as processing, count(*) filter (where o_orderkey % 17 = 0) as failed,
          min(case when o_orderstatus = 'O' then o_orderdate end) as oldest_queued, max(case when o_orderstatus = 'F' then o_orderdate end) as last_sent from orders""")
def queue_stats_pivot(t: Tables) -> DataFrame:
    is_ = lambda s: F.col("o_orderstatus") == s
    return t.orders.agg(
        F.count_if(is_("F")).alias("sent"), F.count_if(is_("O")).alias("queued"), F.count_if(is_("P")).alias("processing"), F.count_if(F.col("o_orderkey") % 17 == 0).alias("failed"),
        F.min(F.when(is_("O"), F.col("o_orderdate"))).alias("oldest_queued"), F.max(F.when(is_("F"), F.col("o_orderdate"))).alias("last_sent"),
    )


@query("select o_orderstatus as status, coalesce(nullif(o_orderpriority, '5-LOW'), 'manual') as kind, count(*) as n from orders group by 1, o_orderpriority")
def queue_two_key(t: Tables) -> DataFrame:
    """Grouped by the raw column; the shown name is made afterwards."""
    raw = t.orders.groupBy(F.col("o_orderstatus").alias("status"), "o_orderpriority").agg(F.count("*").alias("n"))
    return raw.select("status", F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("manual")).alias("kind"), "n")


@query("""select o_orderkey as id, o_orderpriority as priority, o_orderdate as scheduled from orders
          where o_orderstatus = 'O' and o_orderdate <= timestamp '1999-01-01' and o_orderkey % 4 < 3 order by o_orderpriority, o_orderdate, o_orderkey limit 20""")
def queue_ready(t: Tables) -> DataFrame:
    ready = t.orders.filter("o_orderstatus = 'O' and o_orderdate <= timestamp_ntz '1999-01-01' and o_orderkey % 4 < 3")
    return ready.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("scheduled"))


@query("""select (select count(*) from documents) as articles, (select count(*) from events) as activities, (select count(*) from customer) as users, (select count(distinct source) from documents) as sources,
          (select count(*) from events where ts > timestamp '2024-01-31' - interval 1 day) as today, (select count(*) from conversations) as messages""")
def dashboard_scalar_subqueries(t: Tables) -> DataFrame:
    """One aggregate a table, joined as single rows."""
    docs = t.documents.agg(F.count("*").alias("articles"), F.countDistinct("source").alias("sources"))
    events = t.events.agg(F.count("*").alias("activities"), F.count_if(F.col("ts") > now() - F.expr("interval 1 day")).alias("today"))
    rows = [docs, events, t.customer.agg(F.count("*").alias("users")), t.conversations.agg(F.count("*").alias("messages"))]
    out = rows[0].withColumn("one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


@query("""select rate, case when rate < 80 then 'unhealthy' when rate < 95 then 'degraded' else 'healthy' end as grade
          from (select round(100.0 * count(*) filter (where event_type <> 'error') / count(*), 2)::double as rate from events)""")
def health_success_rate(t: Tables) -> DataFrame:
    rate = F.round(F.lit(100.0) * F.count_if(F.col("event_type") != "error") / F.count("*"), 2)
    return t.events.agg(rate.alias("rate")).withColumn("grade", engagement.health_grade(F.col("rate")))


@query("""select o_orderstatus as status, round(avg(epoch(l_shipdate - o_orderdate)), 3) as mean_seconds, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by 1""")
def avg_processing_seconds(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem.select("l_orderkey", "l_shipdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    took = dates.seconds_between(F.col("o_orderdate"), F.col("l_shipdate"))
    return joined.groupBy(F.col("o_orderstatus").alias("status")).agg(F.round(F.avg(took), 3).alias("mean_seconds"), F.count("*").alias("n"))


@query("select distinct source from documents where source is not null and source <> ''")
def distinct_sources(t: Tables) -> DataFrame:
    return t.documents.filter("source is not null and source <> ''").select("source").distinct()


@query("select lang, source, count(*) as n from documents where n_chars between 500 and 5000 and lang in ('en', 'fr') group by grouping sets ((lang, source), (lang), ())")
def content_rollup(t: Tables) -> DataFrame:
    return t.documents.filter("n_chars between 500 and 5000 and lang in ('en', 'fr')").rollup("lang", "source").agg(F.count("*").alias("n"))


@query("""select coalesce(details, 'Unknown') as page, count(*) as n from (select nullif(event_type, 'view') as details from events) group by 1 order by n desc, page limit 10""")
def top_pages(t: Tables) -> DataFrame:
    page = F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("Unknown"))
    return t.events.groupBy(page.alias("page")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "page").limit(10)


@query("""with d as (select word from documents, unnest(string_split(lower(text), ' ')) as u(word) where length(word) > 3)
          select word, count(*) as n from d group by 1 order by n desc, word limit 15""")
def unnest_keywords(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).filter("length(word) > 3")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query("""select domain, count(*) as n from (select unnest([lang, source]) as domain from documents) group by 1""")
def unnest_domains(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(F.array("lang", "source")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query("""select 'view' as side, event_type, n from (select event_type, count(*) as n from events group by 1) where event_type = 'view'
          union all select 'rest', 'all', count(*) from events where event_type <> 'view'""")
def partition_counts(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", F.struct(F.lit("view").alias("side"), F.lit("view").alias("event_type"))).otherwise(F.struct(F.lit("rest").alias("side"), F.lit("all").alias("event_type")))
    return t.events.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).select("k.side", "k.event_type", "n")


@query("""select c_custkey as user_id, coalesce(n, 0) as alerts from customer left join (select user_id, count(*) as n from events where event_type = 'signup' group by 1) on user_id = c_custkey""")
def relation_counts(t: Tables) -> DataFrame:
    counts = t.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n"))
    return users(t).join(counts, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).cast("long").alias("alerts"))


@query("""select o_orderkey as id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def orphan_orders(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("""select c_custkey as user_id, count(e.event_id) as recent from customer left join events e on e.user_id = c_custkey and e.ts > timestamp '2024-01-30' group by 1""")
def outer_with_time_in_on(t: Tables) -> DataFrame:
    recent = t.events.filter("ts > timestamp_ntz '2024-01-30'").select("user_id", "event_id")
    return users(t).join(recent, "user_id", "left").groupBy("user_id").agg(F.count("event_id").alias("recent"))


@query("select n_name as country, count(*) as suppliers, sum(cast(s_acctbal as decimal(18,2)))::double as balance from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by 1")
def source_countries(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("suppliers"), money("s_acctbal").alias("balance"))


@query("""select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as place, count(*) over (partition by lower(trim(substr(text, 1, 12)))) as same_names from documents
          qualify row_number() over (partition by source order by n_chars desc, doc_id) <= 3""")
def near_name_penalty(t: Tables) -> DataFrame:
    names = Window.partitionBy(F.lower(F.trim(F.substring("text", 1, 12))))
    counted = t.documents.withColumn("same_names", F.count("*").over(names))
    top = listing.top_per_group(counted, ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return top.select("doc_id", F.col("rank").cast("long").alias("place"), "same_names")


@query("""select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as asked_at from conversations""")
def forward_fill(t: Tables) -> DataFrame:
    asked = t.conversations.withColumn("asked", F.when(F.col("role") == "user", F.col("turn")))
    return listing.forward_filled(asked, "asked", ["conv_id"], [F.col("turn")], "asked_at").select("conv_id", "turn", "asked_at")


@query("""select event_id, coalesce(first_value(case when event_type in ('error', 'purchase') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), event_type) as latched from events""")
def latched_fold(t: Tables) -> DataFrame:
    found = listing.latched(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", ["error", "purchase"])
    return found.select("event_id", "latched")


@query("""select side, doc_id from (select 'made' as side, doc_id from (select doc_id from documents where doc_id % 7 <> 0 except all select doc_id from documents where doc_id % 5 <> 0)
          union all select 'stored', doc_id from (select doc_id from documents where doc_id % 5 <> 0 except all select doc_id from documents where doc_id % 7 <> 0))""")
def drift_check(t: Tables) -> DataFrame:
    ids = t.documents.select("doc_id")
    return listing.drift(ids.filter("doc_id % 7 <> 0"), ids.filter("doc_id % 5 <> 0")).select("side", "doc_id")


@query("""with s as (select p_type as section, p_partkey as id, p_retailprice as price from part),
          r as (select *, row_number() over (partition by section order by price desc, id) as rank from s),
          o as (select *, 0 as tier from r where rank <= 2 union all select *, 1 from (select * from r where rank > 2 order by price desc, id limit 40))
          select section, id, tier, row_number() over (order by tier, price desc, id) as place from o order by tier, price desc, id limit 40""")
def candidate_backfill(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_type").alias("section"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    chosen = listing.with_backfill(parts, "section", [F.desc("price"), F.col("id")], 2, 40)
    return chosen.select("section", "id", "tier", F.col("place").cast("long").alias("place"))


@query("""select p_type as section, p_partkey as id, row_number() over (partition by p_type order by p_size desc, p_partkey) as rank from part
          qualify row_number() over (partition by p_type order by p_size desc, p_partkey) <= 3""")
def candidate_select_quota(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_type").alias("section"), F.col("p_partkey").alias("id"), "p_size")
    top = listing.top_per_group(parts, ["section"], [F.desc("p_size"), F.col("id")], 3)
    return top.select("section", "id", F.col("rank").cast("long").alias("rank"))


@query("""with r as (select p_type as section, p_partkey as id, p_size % 3 = 0 as ok, row_number() over w as turn, coalesce(sum((p_size % 3 = 0)::int) over (w rows between unbounded preceding and 1 preceding), 0) as had
          from part window w as (partition by p_type order by p_retailprice desc, p_partkey))
          select section, id, ok, turn from r where turn <= 30 and had < 2 order by turn, section limit 30""")
def round_robin_preflight(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_type").alias("section"), F.col("p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("ok"), "p_retailprice")
    visits = listing.round_robin(parts, "section", [F.desc("p_retailprice"), F.col("id")], F.lit(2), "ok", 30)
    return visits.select("section", "id", "ok", F.col("turn").cast("long").alias("turn"))
