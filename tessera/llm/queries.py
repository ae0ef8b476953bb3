"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import divergence, media, mixing, near_dedup, packing, quality, ranked, repeats, sharding, superkmers, token_files, topk, url_filter
from tessera.llm.scratch import new_path

#: The vocabulary of the token queries, and the id that ends a document.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, END_ID, capacity=4096)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=200)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, net, ["doc_id"], threshold=0.3)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return token_files.read_token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


#: The entries and fetch times of the URL query; the tables have neither, so both are rules.
#: Hosts seen in the pages are listed, by a digest of the name: one in four for some time on
#: list ads (as hosts), one in five domains on list spam, and of it one in two is removed later;
#: one in three first path segments on list paths. A page is fetched on day page_id % 366.
FETCHED = "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(page_id % 366 as int), cast(page_id % 24 as int), 0, 0)"


def _list_entries(pages: DataFrame) -> DataFrame:
    part = url_filter.url_parts(F.col("url"))
    seen = pages.filter("url is not null").select(part["host"].alias("host"), F.split(part["path"], "/")[1].alias("segment")).distinct()
    hosts = seen.select("host").distinct()
    number = F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")

    def dated(names: DataFrame, list_name: str, kind: str, action: str, one_in: int, least: int) -> DataFrame:
        day = F.date_add(F.lit("2024-01-01").cast("date"), (least + F.pmod(F.floor(number / 64), F.lit(180))).cast("int"))
        picked = names.distinct().filter(F.pmod(number, F.lit(one_in)) == 0)
        return picked.select(F.lit(list_name).alias("list_name"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), day.cast("timestamp_ntz").alias("since"))

    domain = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+)$", 1).alias("pattern"))
    host = hosts.select(F.col("host").alias("pattern"))
    prefix = seen.filter("segment <> ''").select(F.concat_ws("/", "host", "segment").alias("pattern"))
    parts = [
        dated(host, "ads", "host", "add", 4, 0),
        dated(host, "ads", "host", "remove", 8, 200),
        dated(domain, "spam", "domain", "add", 5, 0),
        dated(domain, "spam", "domain", "remove", 10, 150),
        dated(prefix, "paths", "prefix", "add", 3, 60),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr(FETCHED).alias("fetched_at"))
    return url_filter.filter_urls(captures, _list_entries(pages))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80).documents


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so every vector is drawn as 8 x 8 grey tiles; a row whose id is 3
    modulo 10 shows a cropped and brightened copy of the row before it."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = vectors.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("shown"))
    is_copy = F.coalesce(F.pmod("vec_id", F.lit(10)) == 3, F.lit(False))
    shown = vectors.join(before, "vec_id", "left").select(
        "vec_id", F.when(is_copy & F.col("shown").isNotNull(), F.col("shown")).otherwise(F.col("embedding")).alias("embedding"), (is_copy & F.col("shown").isNotNull()).alias("crop")
    )
    return media.image_copies(media.rendered(shown))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), k=200, least_docs=3)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op13_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.remove_windows(_table(spark, sf_dir, "documents"), window=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_mixing": op4_mixing,
    "op5_token_files": op5_token_files,
    "op6_topk": op6_topk,
    "op7_url_filter": op7_url_filter,
    "op8_near_dedup": op8_near_dedup,
    "op9_image_copies": op9_image_copies,
    "op10_sharding": op10_sharding,
    "op11_divergence": op11_divergence,
    "op12_ranked_search": op12_ranked_search,
    "op13_passages": op13_passages,
}

SQL: dict[str, str] = {
    "op4_mixing": r"""
        with base as (
          select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
                 md5('mix|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as draw
          from documents),
        sizes as (select source, sum(size)::bigint as source_size, count(*) as source_docs from base group by source),
        shape as (select greatest(1, cast(floor(floor(sum(source_size) * 1.5) / 1048576) as bigint)) as block from sizes),
        weighed as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight from sizes),
        capped as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as reach from weighed),
        levels as (
          select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over rising, 0)) / (sum(weight) over () - coalesce(sum(weight) over rising, 0)) as level
          from capped window rising as (order by reach, source nulls last rows between unbounded preceding and 1 preceding)),
        goals as (select source, source_size, source_docs, least(cap, max(level) over () * weight) as target from levels),
        shares as (
          select g.*, block, cast(round(sum(target) over () / block) as bigint) as blocks, count(*) over () as n_sources,
                 case when sum(target) over () > 0 then target * cast(round(sum(target) over () / block) as bigint) / sum(target) over () else 0 end as share
          from goals g, shape),
        slack as (select *, cast(ceil(case when blocks > 0 then share * n_sources / (2 * blocks) else 0 end) as bigint) + 2 as spare from shares),
        granted as (select *, greatest(0, cast(floor(share) as bigint) - spare) as granted, cast(ceil(share) as bigint) + spare as last from slack),
        listed as (
          select source, blocks - sum(granted) over () as open_blocks, target, granted, last from granted),
        quotients as (select source, open_blocks, k, target / (2 * k + 1) as quotient from (select *, unnest(range(granted, last + 1)) as k from listed where target > 0)),
        won as (
          select source, count(*) as won
          from (select *, row_number() over (order by quotient desc, source nulls last, k) as place from quotients) where place <= open_blocks group by source),
        quotas as (
          select g.source, source_size, source_docs, target, block, least((granted + coalesce(won, 0)) * block, source_size * 2) as quota
          from granted g left join won w on g.source is not distinct from w.source),
        dealt as (
          select b.doc_id, b.source, b.size, b.draw, q.source_size, q.target, q.quota, q.block,
                 cast('0x' || substr(draw, 1, 8) as bigint) % (source_docs // 2048 + 1) as shard
          from base b join quotas q on b.source is not distinct from q.source),
        parts as (
          select source, shard, quota, source_size, block, sum(size)::bigint as part from dealt group by all),
        ends as (
          select *, coalesce(cast((quota::hugeint * sum(part) over (partition by source order by shard)::hugeint) // nullif(source_size, 0) as bigint), 0) as upto from parts),
        cuts as (select *, upto - coalesce(lag(upto) over (partition by source order by shard), 0) as part_quota from ends),
        rings as (
          select source, shard, part, case when part > 0 then part_quota // part else 0 end as turns, case when part > 0 then part_quota % part else 0 end as rest,
                 case when part // block > 0
                      then cast('0x' || substr(md5('mix|start|' || coalesce(source, '') || '|' || shard), 1, 12) as bigint) % (part // block) * block else 0 end as first
          from cuts),
        laid as (
          select d.*, coalesce(sum(size) over (partition by source, shard order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as lo from dealt d)
        select doc_id, size, l.source_size, target,
               cast(turns * size + least(greatest(first + rest - lo, 0), size) - least(greatest(first - lo, 0), size)
                    + least(greatest(first + rest - part - lo, 0), size) as bigint) as taken
        from laid l join rings r on l.source is not distinct from r.source and l.shard = r.shard
    """,
    "op7_url_filter": r"""
        with base as (
          select page_id, url, timestamp '2024-01-01 00:00:00' + to_days(cast(page_id % 366 as int)) + to_hours(cast(page_id % 24 as int)) as fetched_at,
                 regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as rest
          from pages),
        parts as (
          select page_id, url, fetched_at, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) as path,
                 regexp_replace(lower(regexp_extract(regexp_extract(rest, '^([^/?#]*)', 1), '^(?:.*@)?([^:]*)', 1)), '\.+$', '') as host
          from base),
        seen as (select distinct host, string_split(path, '/')[2] as segment from parts where url is not null),
        hosts as (select distinct host as pattern from seen),
        domains as (select distinct regexp_extract(pattern, '([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+)$', 1) as pattern from hosts),
        prefixes as (select distinct host || '/' || segment as pattern from seen where segment <> ''),
        named as (
          select 'ads' as list_name, 'host' as kind, 'add' as action, 4 as one_in, 0 as least_day, pattern from hosts
          union all select 'ads', 'host', 'remove', 8, 200, pattern from hosts
          union all select 'spam', 'domain', 'add', 5, 0, pattern from domains
          union all select 'spam', 'domain', 'remove', 10, 150, pattern from domains
          union all select 'paths', 'prefix', 'add', 3, 60, pattern from prefixes),
        entries as (
          select list_name, kind, lower(trim(pattern)) as pattern, action,
                 cast(date '2024-01-01' + cast(least_day + (cast('0x' || substr(md5(pattern), 1, 8) as bigint) // 64) % 180 as int) as timestamp) as since
          from named where cast('0x' || substr(md5(pattern), 1, 8) as bigint) % one_in = 0),
        once as (select list_name, kind, pattern, since, bool_or(action = 'remove') as removed from entries group by all),
        spans as (select *, lead(since) over (partition by list_name, kind, pattern order by since) as until from once),
        asked as (select distinct url, fetched_at, host, list_filter(string_split(path, '/'), lambda x: x <> '') as segments, string_split(host, '.') as labels from parts where url is not null),
        keys as (
          select url, fetched_at, 'host' as kind, host as pattern from asked
          union all select url, fetched_at, 'domain', array_to_string(labels[i:], '.') from (select *, unnest(range(1, len(labels) + 1)) as i from asked)
          union all select url, fetched_at, 'prefix', host || '/' || array_to_string(segments[:i], '/') from (select *, unnest(range(1, least(len(segments), 4) + 1)) as i from asked)),
        active as (
          select k.url, k.fetched_at, count(distinct list_name) as n_lists, min(list_name) as first_list
          from keys k join spans s on s.kind = k.kind and s.pattern = k.pattern and not s.removed
               and s.since <= k.fetched_at and (s.until is null or k.fetched_at < s.until)
          group by all)
        select page_id, b.url, b.fetched_at, coalesce(n_lists, 0) > 0 as blocked, coalesce(n_lists, 0) as n_lists, first_list
        from base b left join active a on a.url = b.url and a.fetched_at = b.fetched_at
    """,
    "op8_near_dedup": r"""
        with recursive base as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
          select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as s from base),
        items as (select doc_id, len(s) as n, unnest(s) as g from sets),
        shared as (
          select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as c
          from items a join items b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
        links as (select x, y from shared where 100 * c >= 80 * (nx + ny - c)),
        both_ways as (select x, y from links union select y, x from links),
        reach(doc_id, other) as (select doc_id, doc_id from sets union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other),
        least_one as (select doc_id, min(other) as component_id from reach group by 1)
        select s.doc_id, cast(len(s) as bigint) as n_shingles, component_id, s.doc_id = component_id as kept from sets s join least_one l on l.doc_id = s.doc_id
    """,
    "op6_topk": """
        with v as (select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as values
                   from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.row_id, q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.values as double[]), cast(c.values as double[])) as bigint) as score
                   from v q join v c on q.row_id <> c.row_id where q.vec_id % 50 = 0)
        select query_id, cast(row_number() over (partition by row_id order by score desc, vec_id nulls last) as int) as rank, vec_id, score
        from s qualify row_number() over (partition by row_id order by score desc, vec_id nulls last) <= 5
    """,
    "op11_divergence": r"""
        with texts as (
          select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
          from documents),
        said as (select row_id, lang, source, unnest(w) as term from texts),
        kept as (select lang, term, count(*) as total from said group by lang, term having count(distinct row_id) >= 3),
        counts as (select lang, source, term, count(*) as n from said semi join kept using (lang, term) group by all),
        langs as (select lang, count(*) as v, sum(total)::hugeint as lang_n from kept group by lang),
        sizes as (
          select g.lang, g.source, coalesce(v, 0) as v, coalesce(lang_n, 0) as lang_n, coalesce(group_n, 0)::hugeint as group_n
          from (select distinct lang, source from texts) g left join langs using (lang)
               left join (select lang, source, sum(n) as group_n from counts group by all) s on s.lang = g.lang and s.source = g.source),
        chances as (
          select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.group_n + s.v) as p,
                 1 + (1000000000::hugeint * (k.total + 1)) // (s.lang_n + s.v) as q
          from sizes s join kept k on k.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term),
        summed as (
          select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
          from chances a join chances b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
        pairs as (
          select a.lang, a.source, b.source as item, coalesce(value, 0) as value
          from sizes a join sizes b on b.lang = a.lang and b.source <> a.source left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        parts as (
          select lang, source, 'pair' as part, item, value from pairs
          union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from chances where n > 0 and p > q)
        select lang, source, part, item, cast(value as bigint) as value, cast(row_number() over best as int) as rank from parts
        window best as (partition by lang, source, part order by value desc, item) qualify part = 'pair' or row_number() over best <= 200
    """,
    "op12_ranked_search": r"""
        with texts as (
          select row_number() over () as row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
          from documents),
        totals as (select count(*) filter (len(w) > 0) as n_all, cast(sum(len(w)) as bigint) as l_all from texts),
        items as (
          select row_number() over () as item_row, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as terms
          from benchmark),
        asked as (select item_row, item_id, unnest(terms) as term from items),
        postings as (
          select row_id, doc_id, n, term, count(*) as tf
          from (select row_id, doc_id, len(w) as n, unnest(w) as term from texts) where term in (select term from asked) group by all),
        weights as (
          select term, cast(floor(1000 * ln(cast(2 * n_all + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from postings, totals group by term, n_all),
        scores as (
          select item_row, item_id, row_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_all) // l_all)))) as bigint) as score
          from asked join postings using (term) join weights using (term), totals group by all)
        select item_id, cast(row_number() over best as int) as rank, doc_id, score from scores where score > 0
        window best as (partition by item_row order by score desc, doc_id nulls last) qualify row_number() over best <= 10
    """,
    "op13_passages": r"""
        with texts as (
          select row_number() over () as row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        windows as (select row_id, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as k from (select *, unnest(range(1, len(w) - 48)) as i from texts)),
        firsts as (select k, min(coalesce(doc_id, 9223372036854775807)) as first_doc from windows group by k),
        cut as (select row_id, i from windows join firsts using (k) where first_doc < coalesce(doc_id, 9223372036854775807)),
        gone as (select distinct row_id, unnest(range(i, i + 50)) as i from cut),
        kept as (
          select row_id, string_agg(w[i], ' ' order by i) as body, count(*) as n
          from (select *, unnest(range(1, len(w) + 1)) as i from texts) anti join gone using (row_id, i) group by row_id)
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
        from texts left join kept using (row_id)
    """,
}
