"""URLs, texts, matching and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, metrics, text, urls
from tessera.operators import listing, matching, registry, scoring
from tessera.plans.registry import AS_OF, Tables, query
from tessera.sources import html

_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\.', '')"
_BARE = r"regexp_replace(trim(url), '#.*$', '')"
_DEDUP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '([?&])utm_(source|medium|campaign)=[^&]*', '\1', 'g'), '\?&+', '?'), '&{2,}', '&', 'g'), '[?&]+$', '')"
_APPROVED = rf"""(select page_id, url, {_HOST} as host, lower(regexp_extract(b, '^([A-Za-z]+)://', 1)) || '://' || {_HOST} || regexp_replace(regexp_extract(b, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/$', '')
             || case when q <> '' then '?' || q else '' end as form
             from (select *, {_BARE} as b, array_to_string(list_filter(string_split(regexp_extract({_BARE}, '\?(.*)$', 1), '&'), lambda p: not starts_with(p, 'utm_')), '&') as q from pages))"""


@query(f"select page_id, form from {_APPROVED}")
def url_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.approval_form(F.col("url")).alias("form"))


@query(f"select page_id, k as dedup_key from (select page_id, {_DEDUP} as k from pages) qualify row_number() over (partition by k order by page_id) = 1")
def url_dedup(t: Tables) -> DataFrame:
    keyed = t.pages.select("page_id", urls.dedup_key(F.col("url")).alias("dedup_key"))
    return listing.latest(keyed, ["dedup_key"], [F.col("page_id")])


@query(f"""select page_id, case when host = 'blog.example.org' then 'r1' when host like '%.example.org' then 'r2' when contains(form, '/fr') then 'r3' when starts_with(form, 'https://m.') then 'r4' end as record_id from {_APPROVED}""")
def url_pattern_match(t: Tables) -> DataFrame:
    entries = [(1, "r1", "exact", "https://blog.example.org"), (2, "r2", "host", "example.org"), (3, "r3", "contains", "/fr/"), (4, "r4", "prefix", "https://m.")]
    known = t.spark.createDataFrame(entries, "ordinal int, record_id string, kind string, value string")
    return registry.pattern_match(t.pages, known).select("page_id", "record_id")


@query(f"""with p as (select * from (values ('example.com', 'com'), ('example.net', 'net'), ('org', 'org'), ('example.org', 'example org')) as v(domain, label)),
          h as (select page_id, {_HOST} as host from pages)
          select page_id, arg_max(p.label, length(p.domain)) as label from h left join p on host = domain or ends_with(host, '.' || domain) group by 1""")
def publisher_suffix(t: Tables) -> DataFrame:
    policy = t.spark.createDataFrame([("example.com", "com"), ("example.net", "net"), ("org", "org"), ("example.org", "example org")], "domain string, label string")
    return matching.publisher(t.pages.select("page_id", urls.host(F.col("url")).alias("host")), policy).select("page_id", "label")


@query(f"select {_HOST} as host, count(*) as n from pages group by 1")
def pages_by_host(t: Tables) -> DataFrame:
    return t.pages.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query()
def html_text_extract(t: Tables) -> DataFrame:
    return html.article_text(t.pages)


@query()
def html_list_items(t: Tables) -> DataFrame:
    return html.page_rows(t.pages, row="li", cell="a")


_SCORED = f"""(select page_id, host, least(100, case when contains(p, ' the ') then 25 else 0 end + case when contains(p, ' tion ') then 10 else 0 end + case when contains(p, ' and ') then 10 else 0 end
             + case when contains(p, ' of ') then 6 else 0 end + case when contains(p, ' que ') then 6 else 0 end) as relevance,
             greatest(0, least(100, 45 + case when regexp_matches(host, '\\.org$') then 12 else 0 end - case when contains(host, 'blog') then 12 else 0 end + case when page_id % 7 = 0 then 30 else 0 end)) as authority,
             case when page_id % 11 = 0 then 45 when page_id * 9 <= 180 then 100 when page_id * 9 <= 365 then 90 when page_id * 9 <= 1095 then 75 when page_id * 9 <= 1825 then 60 else 40 end as freshness
             from (select page_id, {_HOST} as host, ' ' || trim(regexp_replace(replace(lower(html), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) || ' ' as p from pages))"""


def scored_pages(t: Tables) -> DataFrame:
    host = urls.host(F.col("url"))
    day = F.when(F.col("page_id") % 11 != 0, F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("page_id") * 9).cast("int")))
    return t.pages.select(
        "page_id", host.alias("host"), scoring.relevance(F.col("html"), "the", ["tion", "and"], ["of", "que"]).alias("relevance"),
        scoring.authority(host, F.lit(""), F.col("page_id") % 7 == 0).alias("authority"), scoring.freshness(day, F.expr(AS_OF)).alias("freshness"),
    )


@query(f"select page_id, relevance, authority, freshness from {_SCORED}")
def evidence_scores(t: Tables) -> DataFrame:
    return scored_pages(t).select("page_id", "relevance", "authority", "freshness")


@query(f"select page_id, round(0.45::double * authority + 0.35::double * relevance + 0.20::double * freshness, 4) as score from {_SCORED} where relevance >= 20 or authority >= 75 order by score desc, page_id limit 24")
def source_rank(t: Tables) -> DataFrame:
    return scoring.ranked_sources(scored_pages(t), "page_id", 24).select("page_id", "score")


@query(f"""select page_id, case when not host like '%.example.%' then 'not-approved' when relevance < 31 then 'logic' when authority < 45 then 'authority' when freshness < 60 then 'freshness' end as reason from {_SCORED}""")
def approval_gate(t: Tables) -> DataFrame:
    rules = {"not-approved": F.col("host").contains(".example."), "logic": F.col("relevance") >= 31, "authority": F.col("authority") >= 45, "freshness": F.col("freshness") >= 60}
    return scored_pages(t).select("page_id", scoring.first_reason(rules).alias("reason"))


_STOP = "['s.a.', 'ltd', 'inc', 'co', 'company', 'corporation', 'limited', 'plc', 'corp']"
_NAMES = "(select case p_partkey % 3 when 0 then upper(p_name) when 1 then p_name || ' Ltd' else p_name || ' of ' || p_type end as name from part)"


@query(f"""with n as (select distinct name from {_NAMES}), c as (select p_partkey as company_id, p_name as company from part),
          nw as (select name, list_filter(string_split(lower(name), ' '), lambda w: not list_contains({_STOP}, w)) as words from n),
          cw as (select company_id, company, list_filter(string_split(lower(company), ' '), lambda w: not list_contains({_STOP}, w)) as own from c),
          s as (select name, company_id, company, lower(name) = lower(company) as equal,
                       len(list_filter(words, lambda w: list_contains(own, w)))::double / len(words) as share,
                       1 - abs(length(name) - length(company))::double / greatest(length(name), length(company)) as lengths from nw, cw),
          r as (select name, company_id, case when equal then 1.0 else round(0.7::double * share + 0.3::double * lengths, 6) end as score from s where equal or share >= 0.8)
          select name, company_id, score::double as score from r where score >= 0.6
          qualify row_number() over (partition by name order by score desc, company_id) = 1""")
def company_fuzzy_match(t: Tables) -> DataFrame:
    """Names in capitals, with a legal form, or with words more."""
    shown = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" Ltd"))).otherwise(F.concat("p_name", F.lit(" of "), "p_type"))
    names = t.part.select(shown.alias("name"))
    return matching.fuzzy_match(names, t.part.select(F.col("p_partkey").alias("company_id"), F.col("p_name").alias("company"))).select("name", "company_id", "score")


@query("""with n as (select distinct case when s_suppkey % 2 = 0 then lower(s_name) else string_split(s_name, '#')[1] end as name from supplier),
          c as (select s_suppkey as company_id, replace(s_name, '#', ' ') as company from supplier union all select -s_suppkey, s_name from supplier where s_suppkey % 4 = 0),
          m as (select name, company_id, company, case when lower(trim(company)) = lower(trim(name)) then 0
                       when len(list_filter(string_split(lower(trim(name)), ' '), lambda w: not list_contains(string_split(lower(trim(company)), ' '), w))) = 0 then 1 end as tier from n, c)
          select name, company_id, company, tier from m where tier is not null qualify row_number() over (partition by name order by tier, company_id) = 1""")
def company_priority_match(t: Tables) -> DataFrame:
    names = t.supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.lower("s_name")).otherwise(F.split("s_name", "#")[0]).alias("name"))
    spaced = t.supplier.select(F.col("s_suppkey").alias("company_id"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("company"))
    raw = t.supplier.filter("s_suppkey % 4 = 0").select((-F.col("s_suppkey")).alias("company_id"), F.col("s_name").alias("company"))
    return matching.priority_match(names, spaced.unionByName(raw)).select("name", "company_id", "company", "tier")


@query("select doc_id, cast(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) as bigint) as words, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) < 20 as scanned from documents")
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("words"), text.is_scanned(F.col("text")).alias("scanned"))


@query("select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9]+')) as bigint) as n_tokens, list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') as has_the from documents")
def token_counts(t: Tables) -> DataFrame:
    found = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.array_contains(found, "the").alias("has_the"))


@query("select item_id, trim(regexp_replace(text, '[\\s\\x00]+', ' ', 'g')) as clean, substr(sha256(text), 1, 12) as short_id from benchmark")
def text_sanitised(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.collapse(F.col("text")).alias("clean"), text.short_id(F.col("text")).alias("short_id"))


@query("select item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as safe, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) as slug from benchmark")
def text_slugs(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.escape_html(F.col("text")).alias("safe"), text.slug(F.col("text")).alias("slug"))


@query("""with p as (select conv_id, turn, trim(p) as p, o from (select conv_id, turn, unnest(string_split(text, '. ')) as p, generate_subscripts(string_split(text, '. '), 1) as o from conversations) where trim(p) <> '')
          select conv_id, count(*) as parts, max(length(p)) as longest from p group by 1""")
def clause_parts(t: Tables) -> DataFrame:
    parts = t.conversations.select("conv_id", F.explode(F.split("text", "\\. ")).alias("p")).withColumn("p", F.trim("p")).filter("p <> ''")
    return parts.groupBy("conv_id").agg(F.count("*").alias("parts"), F.max(F.length("p")).cast("long").alias("longest"))


@query("""select case when quality >= 0.6 and toxic >= 0.6 then 'both' when quality >= 0.6 then 'esg' when toxic >= 0.6 then 'credit' else 'neither' end as bucket, count(*) as n, sum(greatest(quality, toxic))::bigint as confidence from labels group by 1""")
def classification_bucket(t: Tables) -> DataFrame:
    bucket = scoring.scope_bucket(F.col("quality"), F.col("toxic"))
    return t.labels.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(F.greatest("quality", "toxic")).alias("confidence"))


@query("""with r as (select p_type as section, p_partkey as id, p_size % 4 = 0 as ok, row_number() over (partition by p_type order by p_retailprice, p_partkey) as rank from part),
          w as (select section, min(case when ok then rank end) as hit from r group by 1)
          select w.section, (select id from r where r.section = w.section and rank = hit) as winner, cast((select count(*) from r where r.section = w.section and not ok and (hit is null or rank < hit)) as int) as failures from w""")
def first_success_candidate(t: Tables) -> DataFrame:
    parts = t.part.select(F.col("p_type").alias("section"), F.col("p_partkey").alias("id"), (F.col("p_size") % 4 == 0).alias("ok"), "p_retailprice")
    return scoring.first_success(listing.ranked(parts, ["section"], [F.col("p_retailprice"), F.col("id")]), "section", "rank", "ok", "id").select("section", "winner", "failures")


@query("""select k // 20 as bucket, count(*) as n, min(k) as lowest, max(k) as highest from (select cast(json_extract_string(props, '$.k') as int) as k from events) group by 1""")
def json_buckets(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(k.alias("k")).groupBy(F.floor(F.col("k") / 20).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("lowest"), F.max("k").alias("highest"))


@query("select conv_id, role, string_agg(text, '|' order by turn) as trail from conversations group by 1, 2")
def ordered_trail(t: Tables) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id", "role").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "|").alias("trail"))


@query()
def metric_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", metrics.metrics(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", "|").alias("tokens"))


@query()
def claim_grounding(t: Tables) -> DataFrame:
    """Each benchmark passage as a claim against the document of the same number."""
    joined = t.benchmark.join(t.documents.select(F.col("doc_id").alias("item_id"), F.col("text").alias("evidence")), "item_id")
    checked = joined.select("item_id", metrics.grounding(metrics.metrics(F.col("text")), metrics.metrics(F.col("evidence"))).alias("g"))
    return checked.select("item_id", "g.supported", F.array_join("g.unsupported", "|").alias("unsupported"))


@query()
def chunk_paragraphs(t: Tables) -> DataFrame:
    chunks = t.documents.select("doc_id", F.posexplode(arrays.packed_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("chunk", "part"))
    return chunks.select("doc_id", "chunk", F.length("part").alias("n_chars"))


@query("select event_type, '{\"type\":\"bar\",\"data\":[' || string_agg('{\"name\":\"' || d || '\",\"value\":' || n || '}', ',' order by d) || '],\"title\":\"By day\"}' as chart from (select event_type, cast(cast(ts as date) as varchar) as d, count(*) as n from events group by 1, 2) group by 1")
def chart_payload(t: Tables) -> DataFrame:
    days = t.events.groupBy("event_type", F.col("ts").cast("date").cast("string").alias("d")).agg(F.count("*").alias("n"))
    return days.groupBy("event_type").agg(arrays.chart(F.col("d"), F.col("n"), "By day").alias("chart"))


@query("select conv_id, list_aggregate(list_sort(list(turn))[-3:], 'string_agg', ',') as last_turns from conversations group by 1")
def bounded_log(t: Tables) -> DataFrame:
    last = listing.top_per_group(t.conversations, ["conv_id"], [F.desc("turn")], 3)
    turns = F.sort_array(F.collect_list("turn"))
    return last.groupBy("conv_id").agg(F.array_join(turns.cast("array<string>"), ",").alias("last_turns"))
