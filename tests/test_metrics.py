import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, metrics

CASES = [
    ("Ferries emit 30% less by 2035.", "Harbour rules name a zero-emission route for 2045.", ["30%", "2035"]),
    ("The fund holds USD 20 million.", "The fund holds USD 20 billion.", ["usd 20 million"]),
    ("Grants of $8 million came on March 4, 2021.", "On 4 March 2021 grants of USD 8 million came.", []),
    ("Tests begin in 2031, on 2031-02-01.", "Only a test of 2030 is planned.", ["2031", "2031-02-01"]),
    ("The audit spans 1999–00.", "Audits were done in 1999 and 2000.", []),
    ("Work lasts from 2018–20.", "Work was seen in 2018 and 2019.", ["2020"]),
    ("Figures are for 2019-05.", "Figures are for 2019-06.", ["2019-05"]),
    ("Nothing is counted here.", "", []),
]


@pytest.mark.parametrize(("claim", "evidence", "missing"), CASES)
def test_grounding(spark, claim, evidence, missing):
    df = spark.createDataFrame([(claim, evidence)], "claim string, evidence string")
    g = df.select(metrics.grounding(metrics.metrics(F.col("claim")), metrics.metrics(F.col("evidence"))).alias("g")).first().g
    assert (g.supported, g.unsupported) == (not missing, missing)


@pytest.mark.parametrize("spelling", ["2022-23", "2022–23", "2022/23", "FY2022–23", "2022–2023"])
def test_year_ranges(spelling):
    assert metrics.metric_tokens(f"in the term {spelling}.") == ["2022", "2023"]


def test_years_attributed(spark):
    clauses = F.array(F.array(F.lit("50%"), F.lit("2030")), F.array(F.lit("3 gw")))
    assert spark.range(1).select(metrics.years_attributed(clauses)).first()[0] == ["3 gw"]


def test_arrays(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lits = lambda *v: F.array(*map(F.lit, v))
    assert one(arrays.last_items(lits(*range(5)), 2)) == [3, 4] and one(arrays.last_items(lits(1), 2)) == [1]
    assert one(arrays.appended(lits(1, 2), F.lit(3), 2)) == [2, 3]
    assert one(arrays.same_set(lits(1, 2, 2), lits(2, 1))) and not one(arrays.same_items(lits(1, 2, 2), lits(2, 1, 1)))
    assert one(arrays.all_different(lits(1, 2))) and not one(arrays.all_different(lits(1, 1)))
    assert one(arrays.scope_applies(lits("Banks and Insurance"), F.lit("banks"))) and not one(arrays.scope_applies(lits("Oil"), F.lit("banks")))
    assert one(arrays.scope_applies(lits("All"), F.lit("x"))) and one(arrays.scope_applies(F.array().cast("array<string>"), F.lit("x")))
    assert one(arrays.json_length(F.lit("[1,2]"))) == 2 and one(arrays.json_length(F.lit("{}"))) == 0
    assert one(arrays.first_json(F.lit('{"a":"","b":"x"}'), ["$.a", "$.b"])) == "x"


def test_packed_paragraphs(spark):
    parts = ["a" * 40, "b" * 40, "c" * 120, "d" * 10]
    df = spark.createDataFrame([("\n\n".join(parts),), ("short",)], "t string")
    got = [r[0] for r in df.select(arrays.packed_paragraphs(F.col("t"), 100, 100)).collect()]
    assert got == [["a" * 40 + "\n\n" + "b" * 40, "c" * 120, "d" * 10], ["short"]]


class Unused:
    def __getattr__(self, name):
        raise AssertionError("a text without digits has no quantity to look for")


def test_texts_without_digits_are_not_matched(monkeypatch):
    monkeypatch.setattr(metrics, "_TOKEN", Unused())
    assert metrics.metric_tokens("march usd percent fy " * 50) == []


def test_quantities_are_those_of_a_scan_of_every_place():
    r = random.Random(2)
    parts = ["1", "20", "2024", "19", "-", "–", "/", " ", "   ", "\n", ".", ",", "%", "us$", "usd", "€", "bn", "million", "march", "Mar", "september", "fy", "FY ", ":", "gw", "basis points", "per cent", "x", "_", "é", "٣", "may "]
    for _ in range(5000):
        body = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        assert [m.span() for m in metrics._quantities(body)] == [m.span() for m in metrics._TOKEN.finditer(body)], body
