"""Tiers of evidence against going through them one page after another."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import collection

ITEMS = "logic_id int, tier string, query int, place int, url string, approved boolean, accepted boolean, authority double, relevance double, freshness double, boost double"


def one_after_another(items, kept):
    """items of one logic, dicts in order."""
    def once(rows, seen=()):
        out, keys = [], set(seen)
        for r in rows:
            if r["url"] and "://" in r["url"] and r["url"].lower() not in keys:
                keys.add(r["url"].lower())
                out.append(r)
        return out

    tier = lambda name: sorted((r for r in items if r["tier"] == name), key=lambda r: (r["query"], r["place"], r["url"] or ""))
    good = lambda r: r["approved"] and r["accepted"]
    read = []
    seeds = once(tier("seed"))
    if seeds:
        for r in seeds[:5]:
            read.append(r)
            if good(r):
                break
        if not any(map(good, read)) and any(r["approved"] for r in read):
            read += [r for r in once(tier("publisher"), [s["url"].lower() for s in seeds]) if r["approved"]][:5]
    else:
        registry = [r for r in once(tier("registry")) if r["approved"]]
        open_ = 5 - min(5, len(registry))
        results, queries = [], sorted({r["query"] for r in tier("search") if r["url"] and "://" in r["url"]})
        for i, q in enumerate(queries):
            if i and len(once(results)) >= open_:
                break
            results += [r for r in tier("search") if r["query"] == q and r["url"] and "://" in r["url"]][:open_]
        read = [r for r in once([*once(tier("registry")), *results]) if r["approved"]][:5]
    able = [r for r in read if good(r) and (r["relevance"] >= 20 or r["authority"] >= 75)]
    base = lambda r: round(r["authority"] * 0.45 + r["relevance"] * 0.35 + r["freshness"] * 0.2, 9)
    able.sort(key=lambda r: -base(r))
    score = lambda r: max(0, min(100, int(base(r) + r["boost"] + 0.5)))
    able.sort(key=lambda r: -score(r))
    return [(f"S{i + 1}", r["url"], r["tier"], score(r)) for i, r in enumerate(able[:kept])], sorted((r["url"], r["tier"]) for r in read if not good(r))


@pytest.mark.parametrize("kept", [2, 10])
def test_tiers(spark, kept):
    rng = random.Random(kept)
    rows = []
    for logic in range(60):
        tiers = rng.choice([["seed", "publisher", "registry"], ["registry", "search"], ["search"], ["seed", "search"]])
        for tier in tiers:
            for query in range(rng.randint(1, 4) if tier == "search" else 1):
                for place in range(rng.randint(0, 7)):
                    url = rng.choice([None, "no url", *[f"https://a.org/{rng.choice('pP')}{rng.randint(0, 12)}" for _ in range(9)]])
                    rows.append((logic, tier, query, place, url, rng.random() < 0.6, rng.random() < 0.5, float(rng.randint(0, 100)), float(rng.randint(0, 60)), float(rng.randint(0, 100)), float(rng.randint(0, 18))))
    names = [c.split()[0] for c in ITEMS.split(", ")]
    sources, rejected = collection.collected(spark.createDataFrame(rows, ITEMS).repartition(3), kept)
    sources, rejected = sources.collect(), rejected.collect()
    for logic in range(60):
        own = [dict(zip(names, r)) for r in rows if r[0] == logic]
        want, turned_down = one_after_another(own, kept)
        got = sorted((r for r in sources if r.logic_id == logic), key=lambda r: int(r.source_id[1:]))
        assert [tuple(r)[1:] for r in got] == want, logic
        assert sorted((r.url, r.tier) for r in rejected if r.logic_id == logic) == turned_down, logic


def test_tiers_of_nulls_and_nothing(spark):
    assert [df.count() for df in collection.collected(spark.createDataFrame([], ITEMS))] == [0, 0]
    rows = [(1, "registry", None, 0, "https://a.org", True, True, None, None, None, None), (1, "registry", 0, 1, "HTTPS://a.org/#x", None, None, 90.0, 0.0, 0.0, 0.0), (1, "search", 0, 0, "https://b.org/?utm_source=1", True, True, 80.0, None, None, None)]
    sources, rejected = collection.collected(spark.createDataFrame(rows, ITEMS))
    assert [tuple(r) for r in sources.collect()] == [(1, "S1", "https://b.org/?utm_source=1", "search", 36)] and rejected.count() == 0


def test_a_page_is_known_by_one_key_in_short_and_in_full(spark):
    cases = [
        ("https://a.org/x", "https://a.org/x"), ("https://a.org", "https://a.org/"), (" HTTPS://A.org/X#f ", "https://a.org/x"), ("https://a.org/x?utm_source=1&b=2", "https://a.org/x?b=2"), ("https://a.org/é/É", "https://a.org/é/é"),
        ("https://a.org/x&&y", "https://a.org/x&y"), ("https://a.org/x\n", "https://a.org/x\n"), ("https://a.org/[~!]'>", "https://a.org/[~!]'>"), ("https:///x", None), ("a.org/x", None), ("", None), (None, None), ("1a://b/c", None),
    ]
    df = spark.createDataFrame(cases, "url string, want string")
    assert [r[0] for r in df.select(F.get(collection.page_keys(F.col("url")), F.lit(0))).collect()] == [c[1] for c in cases]


def test_equal_links_come_in_order_of_their_lines(spark):
    row = lambda line, accepted: (1, "seed", 0, 7, "https://a.org/x", True, accepted, 80.0, 50.0, 0.0, 0.0, line)
    for lines in ([1, 2, 3], [3, 2, 1], [2, 1, 3]):
        items = spark.createDataFrame([row(i, i == 1) for i in lines], ITEMS + ", line int").coalesce(1)
        assert [r.source_id for r in collection.judged(items).collect()] == ["S1"]


def test_concepts(spark):
    cases = [
        ("Methane & flaring cut", "Methane flaring limits in oil fields", ["methane reporting rules"], "claim"), ("Methane flaring reporting", "Methane flaring limits in oil fields", ["methane reporting"], None),
        ("flaring", "Methane flaring limits in oil fields", [], "concept"), ("x", "", None, None), (None, "gas", None, "concept"), ("A gas page", "gas", ["2030", None], None), ("A gas page", "gas", ["water"], "claim"),
    ]
    df = spark.createDataFrame(cases, "page string, concept string, claims array<string>, want string")
    assert [r.got for r in df.select(collection.concept_issue(F.col("page"), F.col("concept"), F.col("claims")).alias("got")).collect()] == [c[3] for c in cases]


def test_t_occurrence(spark):
    rng = random.Random(1)
    draw = lambda n: [rng.choice("aaaabbbccdefghij") for _ in range(n)]
    sets = [(i, draw(rng.randint(0, 6)), rng.randint(0, 4)) for i in range(40)]
    texts = [(i, draw(rng.randint(0, 9))) for i in range(60)]
    got = collection.t_occurrence(spark.createDataFrame(sets, "set_id int, terms array<string>, needed int"), spark.createDataFrame(texts, "text_id int, terms array<string>")).collect()
    want = [(s, t, len(set(a) & set(b))) for s, a, m in sets for t, b in texts if m >= 1 and len(set(a) & set(b)) >= m]
    assert sorted(map(tuple, got)) == sorted(want)


def test_logic_boost(spark):
    rows = [
        ("The World Bank on methane limits", ["world bank"], "Methane limits and methane rules", 12), ("The World of Bank", ["World Bank"], "x", 0), ("alpha bravo charlie delta1 echoes foxtrot", [None, " ", "delta1"], "alpha bravo charlie delta1 echoes foxtrot", 18),
        (None, ["a"], "methane", 0), ("methane", None, None, 0), ("x " * 5000 + "methane", None, "methane", 0),
    ]
    df = spark.createDataFrame(rows, "page string, p array<string>, logic string, want int")
    assert [r[0] for r in df.select(collection.logic_boost(F.col("page"), F.col("p"), F.col("logic"))).collect()] == [r[3] for r in rows]
    marks = spark.createDataFrame([(70.4, 0.0), (95.0, 9.0), (-4.0, 1.0), (70.5, 0.0)], "s double, b double")
    assert [r[0] for r in marks.select(collection.boosted(F.col("s"), F.col("b"))).collect()] == [70, 100, 0, 71]
