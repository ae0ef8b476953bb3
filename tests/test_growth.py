"""Work that grows with the input: rows that plans make, which side joins send, results of equal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins, limits, matching, registry, selection
from tessera.plans import claims as claims_plans
from tessera.plans import selection as selection_plans
from tessera.plans.registry import Tables


def nodes(plan) -> list:
    """The physical nodes of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return nodes(plan.executedPlan())
    if name.endswith("QueryStage"):
        return nodes(plan.plan())
    children = plan.children()
    return [plan, *(n for i in range(children.size()) for n in nodes(children.apply(i)))]


def ran(df) -> tuple[list, list]:
    """The rows of ``df`` and its nodes."""
    rows = df.collect()
    return rows, nodes(df._jdf.queryExecution().executedPlan())


def most_rows(found: list) -> int:
    metrics = [n.metrics().get("numOutputRows") for n in found]
    return max(m.get().value() for m in metrics if m.isDefined())


def _referring(spark):
    named = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    i = F.col("id")
    items = spark.range(300).select("id", F.array(named("s", i % 5)).alias("refs"), F.array(F.lit("u")).alias("links"))
    return items, spark.range(300).select(named("s", i).alias("source_id"), F.lit("u").alias("url"))


def test_items_hit_by_id_are_not_looked_up_by_url(spark):
    items, sources = _referring(spark)
    rows, found = ran(joins.referenced_or_linked(items, "id", "refs", "links", sources))
    assert sorted((r.id, r.source_id) for r in rows) == [(i, f"s{i % 5}") for i in range(300)]
    assert most_rows(found) <= 1000
    apart = spark.createDataFrame([(1, ["s900"], ["u"]), (1, ["s1"], ["u"]), (2, ["s900"], ["u", "v", "u"]), (3, None, None)], "id long, refs array<string>, links array<string>")
    few = spark.createDataFrame([("s1", "v"), ("s2", "u"), ("s3", None)], "source_id string, url string")
    assert sorted(map(tuple, joins.referenced_or_linked(apart, "id", "refs", "links", few).collect())) == [(1, "s1"), (2, "s1"), (2, "s2")]


def test_equal_references_make_one_list(spark):
    items, sources = _referring(spark)
    rows, found = ran(joins.referenced_lists(items, "id", "refs", "links", sources))
    every = ", ".join(sorted(f"s{i}" for i in range(300)))
    assert sorted(map(tuple, rows)) == [(i, every) for i in range(300)]
    assert most_rows(found) <= 1000
    apart = spark.createDataFrame([(1, ["s900"], ["u"]), (1, ["s1"], None), (2, ["s1", "s1"], ["v"]), (3, None, None), (4, ["s7"], ["w"])], "id long, refs array<string>, links array<string>")
    few = spark.createDataFrame([("s1", "v"), ("s2", "u"), ("s3", None), ("s4", "v"), ("s4", "v")], "source_id string, url string")
    assert sorted(map(tuple, joins.referenced_lists(apart, "id", "refs", "links", few).collect())) == [(1, "s1, s2"), (2, "s1, s4")]


def sent_bytes(found: list) -> int:
    """The most bytes that one exchange of a plan that has run took."""
    return max(n.metrics().get("dataSize").get().value() for n in found if n.nodeName() == "Exchange")


def test_lists_of_references_do_not_travel(spark):
    """60 different pairs of ids and links have 300 sources each: items travel as numbers, sources once."""
    items, sources = _referring(spark)
    items = items.withColumn("refs", F.array(F.concat(F.lit("s"), (F.col("id") % 60).cast("string")))).unionByName(items.filter("id < 3").withColumn("refs", F.array(F.lit("t7"))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, found = ran(joins.referenced_lists(items, "id", "refs", "links", sources.unionByName(spark.createDataFrame([("t7", "v")], "source_id string, url string"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    every = [f"s{i}" for i in range(300)]
    assert sorted(map(tuple, rows)) == [(i, ", ".join(sorted(every + ["t7"] * (i < 3)))) for i in range(300)]
    assert sent_bytes(found) <= 100_000


def test_replacements_order_each_list_once(spark, monkeypatch):
    """Lists in blocks of three places, with gaps in several, equal those made one by one."""
    monkeypatch.setattr(selection, "BLOCK", 3, raising=False)
    logics = [(i, -(i // 2), f"s{i % 2}" if i % 9 else None, ["x", "y", None][i % 3], i % 7 == 0) for i in range(60)]
    asked = [(i, [(i * k) % 60 for k in (1, 3, 5, 5)] if i % 4 else None) for i in range(62)]
    found = selection.replacements(spark.createDataFrame(logics, "id long, ordinal int, section string, type string, standard boolean"), spark.createDataFrame(asked, "logic_id long, used array<long>"))
    want = []
    for i, used in asked:
        mine = next((r for r in logics if r[0] == i and r[2] is not None), None)
        rest = [r for r in logics if mine and r[2] == mine[2] and r[0] != i and not r[4] and r[0] not in (used or [])]
        order = [i] * bool(mine) + [r[0] for r in sorted(rest, key=lambda r: (r[3] != mine[3], r[1], r[0]))]
        want += [(i, n, x) for n, x in enumerate(order, 1)]
    rows, made = ran(found)
    assert sorted(map(tuple, rows)) == sorted(want)
    windows = [n for n in made if n.nodeName() == "Window"]
    assert not windows  # the lists are in order before logics meet them


def test_no_row_travels_for_each_logic_and_block(spark, monkeypatch):
    """300 asked logics and a section of 150 blocks meet where the blocks are, in parts of 100 logics."""
    monkeypatch.setattr(selection, "BLOCK", 2, raising=False)
    monkeypatch.setattr(selection, "ASKED", 100, raising=False)
    logics = spark.range(300).select("id", F.col("id").cast("int").alias("ordinal"), F.lit("s").alias("section"), F.lit("x").alias("type"), F.lit(False).alias("standard"))
    asked = spark.range(300).select(F.col("id").alias("logic_id"), F.array(F.col("id") + 1, F.lit(7).cast("long")).alias("used"))
    rows, made = ran(selection.replacements(logics, asked))
    lists = {i: [i] + [j for j in range(300) if j not in (i, i + 1, 7)] for i in range(300)}
    assert sorted(map(tuple, rows)) == sorted((i, n, j) for i, order in lists.items() for n, j in enumerate(order, 1))
    assert max(n.metrics().get("shuffleRecordsWritten").get().value() for n in made if n.nodeName() == "Exchange") <= 2000


def test_candidates_stay_where_they_are(spark):
    """Scores send the short list of requests to the catalog, plans need one order of a section."""
    columns = "id string, catalog_order int, section string, type string, name string, origin string, active_for array<string>, country_scopes array<string>, sector_scopes array<string>, families array<string>, seed_urls array<string>, target string, category string, version string"
    rows = [(f"A{i}", i, "Climate Risks", "General", f"n{i}", "master", [], ["All", "UAE", "All"][: 1 + i % 3], ["All"], [], [], "", "risk", None) for i in range(200)]
    requests = spark.createDataFrame([(1, "UAE", "Banking"), (2, "All", "Banking")], "request_id int, country string, sector string")
    scored = selection.scored(spark.createDataFrame(rows, columns), requests)
    found, made = ran(scored)
    assert sorted((r.request_id, r.id) for r in found) == sorted((q, f"A{i}") for q in (1, 2) for i in range(200))
    assert {r.country_fit for r in found if r.request_id == 1} == {12, 40} and {r.country_fit for r in found if r.request_id == 2} == {40}
    assert not [n for n in made if n.nodeName() in ("Window", "SortMergeJoin")]
    few = scored.filter("request_id = 1 and catalog_order < 4")
    _, made = ran(selection.plan(few))
    assert not [n for n in made if n.nodeName() == "SortMergeJoin"]
    order = [r.id for r in selection.ranked(few).orderBy("place").collect()]
    queues = {s: [r.id for r in selection.plan(few).filter(f"slot = {s}").orderBy("queue_place").collect()] for s in (7, 8)}
    assert queues == {7: [order[0], order[2], order[3], order[1]], 8: [order[1], order[2], order[3], order[0]]}


def _sent_rows(made: list) -> int:
    return max([n.metrics().get("numOutputRows").get().value() for n in made if n.nodeName() == "BroadcastExchange"], default=0)


def test_url_forms_are_not_broadcast(spark):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.org/fr/"), F.col("id").cast("string")).alias("url"))
    known = spark.createDataFrame([(1, "r1", "exact", "https://a.org/fr/7"), (2, "r2", "contains", "/fr/"), (3, "r3", "host", "a.org")], "ordinal int, record_id string, kind string, value string")
    rows, made = ran(registry.pattern_match(pages, known))
    assert {r.page_id: r.record_id for r in rows} == {i: "r1" if i == 7 else "r2" for i in range(500)}
    assert _sent_rows(made) <= 10


def test_lines_that_repeat_a_number_are_sources_of_their_own(spark, tmp_path):
    line = "1L as l_partkey, 5L as l_orderkey, 2 as l_linenumber, 10.0D as l_quantity"
    spark.sql(f"select {line}, 1L as l_suppkey union all select {line}, 2L").write.parquet(f"{tmp_path}/lineitem.parquet")
    pack = claims_plans._pack(Tables(spark, str(tmp_path))).collect()
    assert len({r.url for r in pack}) == 2 and sorted(r.ordinal for r in pack) == [1, 2]


def test_companies_of_one_spelling_are_compared_once(spark):
    names = spark.createDataFrame([("red box of tin",), ("RED BOX",)], "name string")
    companies = spark.range(400).select((500 - F.col("id")).alias("company_id"), F.lit("Red Box Of").alias("company")).unionByName(spark.createDataFrame([(7, "red box"), (3, "Red Box")], "company_id long, company string"))
    rows, made = ran(matching.fuzzy_match(names.unionByName(spark.createDataFrame([("a red box of",)], "name string")), companies))
    assert {(r.name, r.company_id) for r in rows} == {("RED BOX", 3)}
    close = matching.fuzzy_match(spark.createDataFrame([("red box of old tin",)], "name string"), companies.withColumn("company", F.concat("company", F.lit(" old"))))
    rows, made = ran(close)
    assert [(r.company_id, r.company) for r in rows] == [(101, "Red Box Of old")]
    assert most_rows([n for n in made if n.nodeName() in ("SortMergeJoin", "BroadcastHashJoin")]) <= 10


def test_active_seconds_do_not_depend_on_the_order_of_equal_spans(spark):
    spans = spark.sql("select 1L as id, timestamp_ntz '2024-01-01' as a, timestamp_ntz '2024-01-03' as b from range(50) union all select 1L, timestamp_ntz '2024-01-05', timestamp_ntz '2024-01-06' from range(50)")
    assert [tuple(r) for r in limits.active_seconds(spans, "id", "a", "b").collect()] == [(1, 3 * 86400.0, 2)]


def test_evidence_is_read_once_and_sorted_a_few_times(spark):
    """Lines travel once, for sources and rejected pages together, and windows of one order share a sort."""
    lines = spark.range(600).select(*(e.alias(n) for n, e in (
        ("l_partkey", F.col("id") % 120), ("l_orderkey", F.col("id")), ("l_suppkey", F.col("id") % 40), ("l_linenumber", (F.col("id") % 7 + 1).cast("int")), ("l_quantity", F.lit(20.0)), ("l_discount", F.lit(0.05)), ("l_tax", F.lit(0.02)),
    )))
    tables = Tables(spark, "")
    tables.lineitem = lines
    rows, found = ran(selection_plans.evidence_tiers(tables))
    assert {r.tier for r in rows} == {"seed", "registry", "search"} and {r.reason for r in rows} == {None, "not-approved", "not-accepted"}
    names = [n.nodeName() for n in found]
    assert names.count("Range") == 1 and sum("Exchange" in n for n in names) == 1 and names.count("Sort") <= 5
