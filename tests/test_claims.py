"""Claims and verdicts on rows written by hand."""

import itertools

import pytest
from pyspark.sql import functions as F

from tessera.functions import catalog, evidence, text
from tessera.operators import claims

PACK = "driver_id int, ordinal int, source_id string, url string, title string, domain string, content string, approval_id string, usage string, status string, provenance string, authority int, country_scope array<string>, sector_scope array<string>"
DRAFT = "driver_id int, logic_id string, assigned_logic_id string, section string, assigned_section string, type string, assigned_type string, title string, body string, relevance string, indicator string, confidence int, source_links array<string>, source_refs array<string>, country string, sector string"
BODY = "Banks in the UAE must disclose financed emissions to the regulator every year and explain how their portfolios will change."
PROOF = "Under the rule, UAE banks must disclose financed emissions. Other text."


def source(driver=1, ordinal=1, **other):
    row = dict(driver_id=driver, ordinal=ordinal, source_id=f"S{ordinal}", url=f"u{ordinal}", title="t", domain="d", content=PROOF, approval_id="a", usage="direct", status="retrieved", provenance="retrieved-page", authority=90, country_scope=["UAE"], sector_scope=["All"])
    return tuple((row | other).values())


def draft(driver=1, **other):
    row = dict(driver_id=driver, logic_id="l", assigned_logic_id="l", section="s", assigned_section="s", type="Country-related", assigned_type="Country-related", title="UAE banks", body=BODY, relevance="", indicator="", confidence=90, source_links=["u1"], source_refs=["S1"], country="UAE", sector="Banking")
    return tuple((row | other).values())


def verdicts(spark, drafts, pack):
    rows = claims.verify(spark.createDataFrame(drafts, DRAFT), spark.createDataFrame(pack, PACK)).collect()
    return {r.driver_id: r for r in rows}


def test_a_sound_draft_passes(spark):
    v = verdicts(spark, [draft()], [source(), source(ordinal=2)])[1]
    assert (v.passed, v.score, v.recommended, v.reasons, v.can_repair) == (True, 100, 90, [], True)


def test_each_rule_gives_its_reason(spark):
    cases = {
        "driver logic id does not": dict(logic_id="x"),
        "section or type does not": dict(type=None),
        "missing metric year for USD 5 million": dict(indicator="USD 5 million"),
        "relevance is not explicit": dict(title="t", body="Lenders elsewhere plan " + "more of it " * 6),
        "must cite 1 to 3": dict(source_links=None, source_refs=None),
        "outside the evidence pack": dict(source_links=["u1", "nowhere"]),
        "must be unique": dict(source_links=["u1", "u1"]),
        "no linked source could": dict(source_links=["nowhere"], source_refs=[]),
        "source references do not": dict(source_refs=["S2"]),
        "title is too generic": dict(title=" ESG Compliance "),
        "one compact 20 to 50": dict(body=None),
        "Metric not found in linked evidence: 7%": dict(relevance="7% in 2030"),
        "lacks obligation language": dict(body=BODY.replace("financed emissions to the regulator", "water usage")),
        "net-zero alignment claim": dict(relevance="UAE aligned with Net Zero 2050"),
        "net-zero requirement claim": dict(relevance="UAE banks must reach net-zero 2050"),
    }
    found = verdicts(spark, [draft(i, **c) for i, c in enumerate(cases.values())], [source(i) for i in range(len(cases))])
    for i, wanted in enumerate(cases):
        assert any(wanted in r for r in found[i].reasons), (wanted, found[i].reasons)
        assert not found[i].passed and found[i].score < 100


def test_rules_about_sources(spark):
    cases = {
        "not approved driver sources": dict(approval_id=None),
        "context-only source": dict(usage="context"),
        "lack retrieved-page direct": dict(status=None),
        "source S1 does not support UAE relevance": dict(content="Banks must disclose financed emissions"),
        "source S1 appears country-mismatched": dict(content="Banks of Egypt must disclose financed emissions", country_scope=["Global"]),
        "authority is below the required 75; cite a stronger": dict(authority=10),
    }
    pack = [source(i, **c) for i, c in enumerate(cases.values())] + [source(i, 2) for i in range(len(cases))]
    found = verdicts(spark, [draft(i) for i in range(len(cases))], pack)
    for i, wanted in enumerate(cases):
        assert any(wanted in r for r in found[i].source_issues), (wanted, found[i].source_issues)
    alone = verdicts(spark, [draft()], [source(authority=None)])[1]
    assert "no direct source meeting" in alone.source_issues[0] and not alone.can_repair


def test_nulls_and_no_evidence(spark):
    empty = (1,) + (None,) * 15
    v = verdicts(spark, [empty], [])[1]
    assert not v.passed and v.score == 0 and v.recommended == 35 and len(v.reasons) <= claims.MOST_REASONS and v.can_repair
    assert claims.verify(spark.createDataFrame([], DRAFT), spark.createDataFrame([], PACK)).count() == 0
    later = verdicts(spark, [draft()], [source(content=None), source(ordinal=1)[:1] + (9,) + source()[2:]])[1]
    assert later.passed  # of two rows with one URL the last counts


def test_hard_claims_need_one_passage(spark):
    def counts(claim, *contents, direct=True):
        drivers = spark.createDataFrame([(1, [claim, None])], "driver_id int, texts array<string>").select("*", catalog.country_aliases(F.lit("uae")).alias("country_aliases"), catalog.sector_aliases(F.lit("Oil and gas")).alias("sector_aliases"))
        sources = spark.createDataFrame([(1, i, c, direct) for i, c in enumerate(contents)], "driver_id int, source_id int, content string, direct boolean")
        r = claims.hard_claim_support(drivers, sources).first()
        return r.n_claims, r.n_unsupported

    claim = "UAE oil producers must measure methane leaks; nice text"
    assert counts(claim, "In the Émirati and UAE oil field rules, producers shall measure methane") == (1, 0)
    assert counts(claim, "UAE oil producers plan. They must measure methane") == (1, 1)  # two passages, each lacks something
    assert counts(claim, "UAE oil firms must cut methane") == (1, 1)  # one term of two
    assert counts(claim, "Oil producers must measure methane") == (1, 1)  # no country
    assert counts(claim, "UAE oil producers must measure methane", direct=False) == (1, 1)
    assert counts("It must", "UAE oil must") == (1, 1)  # no subject
    assert counts("It must cut methane", "Methane rules are mandatory") == (1, 0)  # one term is enough where there is one
    assert counts("Soft words only", "x") == (0, 0) and counts(claim) == (1, 1)


def test_words_form_takes_marks_apart(spark):
    rows = spark.createDataFrame([("Café—ﬁn  ²3",), ("a&b",), (None,), ("",)], "t string").select(text.words_form(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["cafe fin 23", "a b", None, ""]


def test_undated_quantities(spark):
    rows = spark.createDataFrame([(["Up 5 % in 2030; usd 3 bn saved", "5% again. 7 CO₂ MW"],), ([],)], "t array<string>").select(claims.undated_quantities(F.col("t"))).collect()
    assert rows[0][0] == ["usd 3 bn"] or rows[0][0] == ["usd 3 bn", "7 CO2"]
    assert rows[1][0] == []


def test_combined_verdicts(spark):
    kind = "struct<passed:boolean,score:int,recommended:int,reasons:array<string>,repairs:array<string>,metrics:array<string>,source_issues:array<string>,style_issues:array<string>,can_repair:boolean>"
    good = (True, 90, 85, [], [], [], [], [], True)
    cases = [
        (good, (True, 10, 10, ["fine"], None, None, None, None, False), (True, 90, 85, [], True)),
        (good, (False, 80, 80, [], None, None, None, None, True), (False, 80, 80, ["semantic verifier rejected the driver"], True)),
        (good, (True, 99, 99, [], ["x", "x "], None, None, None, True), (False, 90, 85, ["x"], True)),
        (good, None, (False, 0, 0, ["semantic verifier rejected the driver", "quality score 0 is below the required 75", "evidence-grounded confidence 0 is below the required 75"], False)),
        ((False, 60, 60, ["r"], ["r"], [], [], [], True), (True, 99, 99, None, None, None, None, None, None), (False, 60, 60, ["r", "quality score 60 is below the required 75", "evidence-grounded confidence 60 is below the required 75"], True)),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    for r in df.select("i", claims.combined(F.col("a"), F.col("b")).alias("v")).collect():
        assert (r.v.passed, r.v.score, r.v.recommended, r.v.reasons, r.v.can_repair) == cases[r.i][2]


def test_confidence_and_route_without_parts(spark):
    none = F.lit(None)
    row = spark.range(1).select(
        evidence.derived_confidence(none.cast("double"), none.cast("int"), none.cast("string"), F.lit(0), none.cast("boolean"), F.lit(False), F.lit(False), F.lit(False)).alias("a"),
        evidence.derived_confidence(F.lit(90.0), F.lit(90), F.lit("2030"), F.lit(2), F.lit(True), none.cast("boolean"), none.cast("boolean"), none.cast("boolean")).alias("b"),
        evidence.route(none.cast("boolean"), F.lit(90), F.lit(90), F.lit(90), F.lit(0), F.lit(0), F.lit(1), F.lit(True), F.lit(0)).alias("c"),
        evidence.route(F.lit(False), F.lit(70), F.lit(90), F.lit(90), F.lit(0), F.lit(0), F.lit(1), F.lit(True), F.lit(0)).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (35, 92, "fail", "repair")


@pytest.mark.parametrize("name,status,code,message", list(itertools.product([None, "Error"], [None, "404"], [None, "E1"], [None, "fetch failed!"])))
def test_transient_by_phrase(spark, name, status, code, message):
    kind = "array<struct<name:string,status:string,code:string,message:string>>"
    chain = [(None, None, None, None)] * 7 + [(name, status, code, message)]
    df = spark.createDataFrame([(chain,), (chain[:7] + [(None,) * 4] + chain[7:],), (None,)], f"c {kind}")
    assert [r[0] for r in df.select(evidence.transient(F.col("c"))).collect()] == [message is not None, False, False]


def test_accuracy_review(spark):
    cases = [
        ((None, None, "5% in 2030", 85), [(80, 80)], ("strong", [])), ((None, None, "5% in 2030", 75), [(80, 80)], ("checked", ["moderate confidence"])), ((None, ["A Research Firm"], "scope", 90), [(80, 80)], ("limited", ["generic source label"])),
        ((["w", "w "], [None], "growth", 90), [(80, 80)], ("limited", ["w", "evidence/KPI is not specific"])), ((None, None, "expected 5%", 90), [(69, 90)], ("limited", ["projection needs direct citation"])), ((None, None, "expected 5%", 90), [(70, 9)], ("strong", [])),
        ((None, None, "5%", 90), [(59, 59), (None, None)], ("checked", ["weak source mix"])), ((None, None, None, None), [], ("limited", ["no parsed source detail", "evidence/KPI is not specific", "confidence 0"])),
    ]
    drivers = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "driver_id int, warnings array<string>, key_sources array<string>, indicator string, confidence int")
    sources = spark.createDataFrame([(i, *s) for i, c in enumerate(cases) for s in c[1]], "driver_id int, authority int, score int")
    got = {r.driver_id: (r.level, r.reasons) for r in claims.accuracy_review(drivers, sources).collect()}
    assert got == {i: c[2] for i, c in enumerate(cases)}


def test_day_range_of_one_date(spark):
    import datetime as dt

    days = spark.createDataFrame([(None, dt.date(2024, 3, 1)), (dt.date(2024, 3, 1), None), (None, None), (dt.date(2024, 3, 1), dt.date(2024, 3, 4))], "a date, b date")
    assert [r[0] for r in days.select(evidence.day_range(F.col("a"), F.col("b"))).collect()] == ["1 Mar 2024", "1 Mar 2024", None, "1-4 Mar 2024"]
