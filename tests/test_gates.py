"""Gates of found sources on rows written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates

TODAY = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize(
    "category,day,base,age,version,said,want",
    [
        ("evergreen", None, 45, None, None, None, (True, 45, None)),
        ("standard", None, 45, None, "2.0", "Guide v2.0 text", (True, 55, None)),
        ("standard", dt.datetime(2024, 1, 1), 90, None, "2.0", "version 2x0", (False, 40, "version 2.0.")),
        ("standard", None, 30, None, " ", "the latest active version", (True, 55, None)),
        ("standard", None, 30, None, None, "", (False, 30, "latest active version")),
        ("regulation", dt.datetime(2020, 1, 1), 60, None, None, "", (True, 60, None)),
        ("policy", dt.datetime(2010, 1, 1), 40, None, None, "now IN\n FORCE", (True, 55, None)),
        ("policy", None, 45, 9.0, None, None, (False, 35, "policy source is neither")),
        ("forecast", dt.datetime(2022, 1, 1), 75, None, None, "", (True, 75, None)),
        ("forecast", dt.datetime(2022, 1, 1), 75, 0.01, None, "in 2023", (False, 35, "accepted freshness window")),
        ("market-metric", None, 45, None, None, "up 5% in 2021, 9% by 2050", (True, 60, None)),
        ("market-metric", None, 45, None, None, "1989 and 2050", (False, 35, "no recent publication date")),
    ],
)
def test_freshness(spark, category, day, base, age, version, said, want):
    row = spark.createDataFrame([(category, day, base, age, version, said)], "c string, d timestamp_ntz, b int, a double, v string, s string")
    got = row.select(gates.freshness(*(F.col(c) for c in "cdbavs"), F.lit(TODAY).cast("timestamp_ntz")).alias("v")).first().v
    assert (got.accepted, got.score) == want[:2] and (want[2] or "") in (got.reason or "") and (got.reason is None) == want[0]


RECORD = "struct<record_id:string,usage:string,logic_ids:array<string>,sections:array<string>,countries:array<string>,sectors:array<string>,needs_country:boolean,needs_sector:boolean>"
SOURCE = "struct<title:string,url:string,domain:string,content:string,snippet:string,status:string,provenance:string,contextual:boolean>"
LOGIC = "struct<logic_id:string,type:string,section:string,catalog:boolean,registry_ids:array<string>,country_scopes:array<string>,sector_scopes:array<string>,families:array<string>>"
GOOD = ("r", "direct", None, None, ["Global"], ["All"], None, None)
PAGE = ("t", "u", "d", "UAE banks & more", None, "retrieved", "retrieved-page", None)
PLAIN = ("l", "General", None, False, None, None, None, None)


@pytest.mark.parametrize(
    "record,page,logic,reason",
    [
        (GOOD, PAGE, PLAIN, None), ((None,) * 8, PAGE, PLAIN, "not-approved"), (GOOD, (None,) * 8, PLAIN, "retrieval-failed"), (("r", "context", None, None, ["Global"], ["All"], None, None), (None, None, None, None, "x", None, "approved-context", True), PLAIN, None),
        (("r", "direct", ["other"], None, ["Global"], ["All"], None, None), PAGE, PLAIN, "logic-mismatch"), (("r", "direct", None, None, None, ["All"], None, None), PAGE, PLAIN, "country-mismatch"), (("r", "direct", None, None, ["Global"], None, None, None), PAGE, PLAIN, "sector-mismatch"),
        (("r", "direct", None, None, ["Global"], ["All"], True, None), (*PAGE[:3], "banks", *PAGE[4:]), PLAIN, "country-mismatch"), (("r", "direct", None, None, ["Global"], ["All"], None, True), (*PAGE[:3], "the UAE", *PAGE[4:]), PLAIN, "sector-mismatch"),
        (("r", "direct", None, None, ["Global"], ["All", "banking"], None, True), (*PAGE[:3], "the UAE", *PAGE[4:]), PLAIN, None), (GOOD, (*PAGE[:3], "nobody", *PAGE[4:]), (*PLAIN[:5], ["United Arab Emirates"], None, None), "country-mismatch"),
        (GOOD, (*PAGE[:3], "the UAE", *PAGE[4:]), (*PLAIN[:5], None, ["Insurance"], None), "sector-mismatch"), (GOOD, (*PAGE[:3], "the UAE", *PAGE[4:]), (*PLAIN[:5], None, ["Mining"], ["Financial Services"]), "sector-mismatch"), (GOOD, PAGE, (None,) * 8, None),
    ],
)
def test_approval(spark, record, page, logic, reason):
    row = spark.createDataFrame([(record, page, logic)], f"r {RECORD}, s {SOURCE}, l {LOGIC}")
    assert row.select(gates.approval_reason(F.col("r"), F.col("s"), F.lit("uae"), F.lit("Banking"), F.col("l"))).first()[0] == reason


def test_first_approval_or_first_rejection(spark):
    rows = [(1, 1, "a"), (1, 2, None), (1, 3, None), (2, 2, "y"), (2, 1, "x"), (None, 1, "z")]
    got = gates.gate_any(spark.createDataFrame(rows, "source_id int, ordinal int, reason string")).collect()
    assert {(r.source_id, r.ordinal, r.reason) for r in got} == {(1, 2, None), (2, 1, "x"), (None, 1, "z")}


def test_publisher_class(spark):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "domain string")
    hosts = spark.createDataFrame([("www.a.org",), ("x.a.org",), ("aa.org",), ("b.com",), ("a.b.com",), (None,), ("b.com",)], "host string")
    got = {r.host: r["class"] for r in gates.publisher_class(hosts, df("WWW.A.org", "a.b.com"), df("b.com", "a.org")).collect()}
    assert got == {"www.a.org": "direct-publisher", "x.a.org": "direct-publisher", "aa.org": "unreviewed", "b.com": "guidance-only", "a.b.com": "direct-publisher"}


def test_penalty(spark):
    rows = spark.createDataFrame([("methane flaring rules", 30, True), ("nothing", 30, True), ("nothing", 10, True), ("nothing", 30, None)], "page string, r int, c boolean")
    assert [r[0] for r in rows.select(gates.relevance_after(F.col("r"), F.col("page"), F.lit("methane flaring limits in fields"), F.lit(None).cast("array<string>"), F.col("c"))).collect()] == [30, 5, 0, 30]
