"""Registry, scores and slots on rows written by hand or drawn at random."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import registry, selection

PATTERNS = "ordinal int, record_id string, kind string, value string"


def brute(form, patterns):
    host = form.split("://")[1].split("/")[0].split("?")[0].split(":")[0]
    for _, record, kind, value in sorted(patterns, key=lambda p: p[0]):
        value = value.strip().removeprefix("www.").removesuffix("/").lower() if not value.lower().startswith("http") else value.rstrip("/")
        if value and {"exact": form == value, "prefix": form.startswith(value), "contains": value in form, "host": host == value or host.endswith("." + value)}[kind]:
            return record
    return None


def test_first_fitting_pattern(spark):
    rng = random.Random(3)
    hosts = ["a.org", "b.a.org", "c.org", "xa.org"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['p', 'q', 'P'])}/{rng.randint(0, 9)}{rng.choice(['', '/', '?x=1', '#z', '?utm_a=1'])}" for _ in range(120)]
    values = ["a.org", "www.C.org/", "https://b.a.org/p", "https://www.a.org/q/3", "/q/", "p/7", "5", "org", " ", "https://c.org", "https:"]
    patterns = [(i, f"r{i}", rng.choice(["exact", "prefix", "contains", "host"]), rng.choice(values)) for i in range(40)]
    rng.shuffle(patterns)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(900, None), (901, "ftp://a.org"), (902, "https://u:p@a.org/")], "page_id int, url string")
    known = spark.createDataFrame(patterns + [(0, "none", "exact", None), (0, "odd", "unknown", "https://a.org")], PATTERNS)
    got = {r.page_id: r for r in registry.pattern_match(pages.withColumn("form", F.lit("x")), known).collect()}
    from tessera.functions.urls import approval_form

    forms = {r.page_id: r.f for r in pages.select("page_id", approval_form(F.col("url")).alias("f")).collect()}
    assert {i: r.record_id for i, r in got.items()} == {i: f and brute(f, patterns) for i, f in forms.items()}
    assert registry.pattern_match(pages, known.limit(0)).filter("record_id is not null").count() == 0


@pytest.mark.parametrize(
    "raw,want",
    [("https://A.org:443/x/?q=1", "https://a.org/x/?q=1"), ("https://a.org:8443", "https://a.org:8443"), ("https://a.org?b=1&UTM_c=2", "https://a.org/?b=1"), ("http://a.org:80/", "http://a.org")],
)
def test_approval_form_keeps_ports_and_slashes(spark, raw, want):
    from tessera.functions.urls import approval_form

    assert spark.createDataFrame([(raw,)], "u string").select(approval_form(F.col("u"))).first()[0] == want


RECORDS = "record_id string, ordinal int, fallback_url string, usage string, logic_ids array<string>, sections array<string>"
LOGIC = "logic_id string, catalog boolean, registry_ids array<string>, section string"


def test_seeds_and_publishers(spark):
    records = spark.createDataFrame([("ctx", 0, "https://a.org", "context", None, None), ("a", 1, "https://www.a.org/", "direct", ["l1"], None), ("a2", 2, "https://a.org/x", "direct", None, ["s1"]), ("b", 3, "https://b.org", "direct", None, None)], RECORDS)
    patterns = spark.createDataFrame([(0, "ctx", "prefix", "https://a.org/ctx"), (1, "a", "exact", "https://a.org/exact"), (3, "b", "host", "b.org")], PATTERNS)
    logic = ("l1", False, None, "s9")
    seeds = [
        (1, "https://a.org/exact", None, None, *logic), (2, "https://sub.a.org/page", "sub.a.org", None, *logic), (3, "https://a.org/p", "other.org", None, *logic), (4, "http://a.org/p", None, None, *logic),
        (5, "https://a.org/p", "", ["a2"], "l2", True, None, None), (6, "https://a.org/p", None, None, "l2", False, ["l1"], None), (7, "https://a.org/ctx/1", None, None, "l9", False, None, "s1"), (8, "https://x.org/", None, None, *logic),
        (9, None, None, None, *logic), (10, "https://q.b.org/z", "https://www.q.b.org/", [], None, None, None, None),
    ]
    got = {r.seed_id: r for r in registry.resolve_seeds(spark.createDataFrame(seeds, f"seed_id int, url string, domain string, requested array<string>, {LOGIC}"), records, patterns).collect()}
    assert {i: r.reviewed_id for i, r in got.items()} == {1: "a", 2: "a", 3: None, 4: None, 5: "a2", 6: "a", 7: "a2", 8: None, 9: None, 10: "b"}
    assert got[1].approval_id == "a" and got[2].approval_id.startswith("catalog-a-") and got[10].approval_id == "b" and got[8].form is None
    found = [
        (1, "https://other.a.org/new", "a", "https://a.org/exact", *logic), (2, "https://a.org/exact", "a", "https://a.org/p", *logic), (3, "https://b.org/new", "a", "https://a.org/p", *logic), (4, "https://a.org/n", "ctx", "https://a.org", *logic),
        (5, "https://a.org/n", "a", "https://b.org", *logic), (6, "https://a.org/n", "a", "https://a.org", "l5", False, None, None), (7, None, "a", "https://a.org", *logic),
    ]
    got = {r.candidate_id: r.reviewed_id for r in registry.resolve_same_publisher(spark.createDataFrame(found, f"candidate_id int, url string, reviewed_id string, seed_form string, {LOGIC}"), records, patterns).collect()}
    assert got == {1: "a", 2: "a", 3: None, 4: None, 5: None, 6: None, 7: None}


def sequential(queues, sound):
    """Slots of one request choose one after another."""
    primaries = {slot: (section, q[0]) for slot, (section, q) in queues.items()}
    used, out = set(), {}
    for slot in sorted(queues):
        section, queue = queues[slot]
        reserved = {p for s, (sec, p) in primaries.items() if s != slot and sec == section}
        out[slot] = next((c for c in queue if c in sound and c not in used and c not in reserved), None)
        used.add(out[slot])
    return out


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_slots_choose_like_one_after_another(spark, share):
    rng = random.Random(int(share * 10))
    rows, sound, want = [], [], {}
    for request in range(6):
        queues = {}
        for slot in range(1, 8):
            section = "s" if slot < 6 else "t"
            backups = [f"{section}b{i}" for i in range(6)]
            rng.shuffle(backups)
            queues[slot] = (section, [f"{section}{slot}", *backups, *(f"{section}{o}" for o in range(1, 8) if o != slot)])
            rows += [(request, slot, section, i + 1, c) for i, c in enumerate(queues[slot][1])]
        good = {c for _, q in queues.values() for c in q if rng.random() < share}
        sound += [(request, c) for c in good] * 2
        want |= {(request, s): c for s, c in sequential(queues, good).items()}
    got = selection.assigned(spark.createDataFrame(rows, "request_id int, slot int, section string, queue_place int, id string"), spark.createDataFrame(sound, "request_id int, id string")).collect()
    assert {(r.request_id, r.slot): r.id for r in got} == want


def test_scores_of_nothing_and_nulls(spark):
    kind = "id string, catalog_order int, section string, type string, name string, origin string, active_for array<string>, country_scopes array<string>, sector_scopes array<string>, families array<string>, seed_urls array<string>, target string, category string, version string"
    requests = spark.createDataFrame([(1, "UAE", "Banking")], "request_id int, country string, sector string")
    rows = [
        ("bare", 1, "Supply Chain", None, None, None, None, ["All"], ["All"], None, None, None, None, None), ("best", 2, "Supply Chain", "Country-related", "N", "specialist", ["Banking"], ["All", "UAE"], ["Banking"], [], ["u"], "CO2 2030 " * 40, "standard", "v"),
        ("gone", 3, "Supply Chain", None, None, None, None, None, ["All"], None, None, None, None, None), ("idle", 4, "Supply Chain", None, None, "specialist", ["Oil & Gas"], ["All"], ["All"], None, None, None, None, None),
        ("esg", 5, "Supply Chain", "General", " ESG ", "master", None, ["UAE"], None, ["Financial Services"], None, None, "evergreen-framework", None),
    ]
    got = {r.id: r for r in selection.scored(spark.createDataFrame(rows, kind), requests).collect()}
    assert {i: r.score for i, r in got.items()} == {"bare": 12 + 12 - 4, "best": 40 + 34 + 12 + 18 + 10 + 7 + 4, "esg": 40 + 20 + 1 + 1 - 6}
    planned = selection.plan(selection.scored(spark.createDataFrame(rows, kind), requests)).collect()
    queues = [(r.slot, r.queue_place, r.id) for r in sorted(planned, key=lambda r: (r.slot, r.queue_place))]
    assert queues == [(11, 1, "best"), (11, 2, "bare"), (11, 3, "esg"), (12, 1, "esg"), (12, 2, "bare"), (12, 3, "best")]
    assert selection.plan(selection.scored(spark.createDataFrame([], kind), requests)).count() == 0



def test_eligible_and_replacements(spark):
    kind = "id string, origin string, seed_urls array<string>, country_scopes array<string>, sector_scopes array<string>"
    rows = [("all", "master", ["u"], ["All"], [" all "]), ("open", "master", ["u"], [], None), ("part", "master", ["u"], ["Saudi Arabia, UAE"], ["Oil"]), ("none", "master", [], ["All"], ["All"]), ("spec", "specialist", ["u"], ["All"], ["All"]), ("other", "master", ["u"], ["Egypt"], ["All"])]
    requests = spark.createDataFrame([(1, "uae", "Oil & Gas"), (2, "Kazakhstan", "Banking"), (3, None, "Banking")], "request_id int, country string, sector string")
    got = {(r.request_id, r.id) for r in selection.eligible(spark.createDataFrame(rows, kind), requests).collect()}
    assert got == {(1, "all"), (1, "open"), (1, "part"), (2, "all"), (2, "open")}
    logics = spark.createDataFrame([("a", 1, "s", "x", True), ("b", 2, "s", "y", None), ("c", 3, "s", "x", False), ("d", 4, "s", "x", True), ("e", 5, "t", "x", False), ("f", 6, "s", "x", False)], "id string, ordinal int, section string, type string, standard boolean")
    asked = spark.createDataFrame([("a", ["f", "a"]), ("e", None), ("zz", [])], "logic_id string, used array<string>")
    found = sorted(tuple(r) for r in selection.replacements(logics, asked).collect())
    assert found == [("a", 1, "a"), ("a", 2, "c"), ("a", 3, "b"), ("e", 1, "e")]
