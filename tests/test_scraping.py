"""Scrape runs against one row after another, and as a stream that repeats batches."""

import random

import pytest

from tessera.operators import scraping
from tessera.streaming import scraping as stream

FOUND = "source string, run int, place int, lot_id string, fetched boolean, fits boolean"


def one_after_another(found, active, stored):
    there, out = set(stored), []
    for r in sorted(found, key=lambda r: (r[1], r[2])):
        source, _, _, lot, fetched, fits = r
        if source not in active:
            what = "no-source"
        elif not active[source]:
            what = "inactive"
        elif lot is not None and (source, lot) in there:
            what = "existing"
        else:
            what = "failed" if not fetched else "filtered" if not fits else "created"
            if what == "created":
                there.add((source, lot))
        out.append((*r, what))
    return out


def drawn(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("abcz"), rng.randint(0, 3), i, rng.choice([None, *"0123456789"]), rng.choice([True, True, False, None]), rng.choice([True, True, False])) for i in range(n)]


ACTIVE = {"a": True, "b": True, "c": False}


def test_outcomes_and_log(spark):
    found, stored = drawn(1, 200), [("a", "3"), ("b", "4"), ("a", "3"), ("b", None)]
    sources = spark.createDataFrame(list(ACTIVE.items()), "source string, is_active boolean")
    judged = scraping.outcomes(spark.createDataFrame(found, FOUND).repartition(3), sources, spark.createDataFrame(stored, "source string, lot_id string"))
    want = one_after_another(found, ACTIVE, stored)
    cols = [c.split()[0] for c in FOUND.split(", ")] + ["outcome"]
    assert sorted((tuple(r) for r in judged.select(*cols).collect()), key=str) == sorted(want, key=str)
    log = {(r.source, r.run): r for r in scraping.run_log(judged).collect()}
    for (source, run), r in log.items():
        own = [w[-1] for w in want if w[0] == source and w[1] == run]
        assert (r.found, r.failed, r.created, r.done) == (len(own), own.count("failed"), own.count("created"), len(own) - own.count("failed"))
        assert r.status == ("partial" if r.failed else "success") and (r.error or "").count("\n") == max(0, r.failed - 1)
    assert {s for s, _ in log} == {"a", "b"}
    totals = {r.source: r for r in scraping.counters(scraping.run_log(judged)).collect()}
    assert totals["a"].total_scrapes == totals["a"].successful_scrapes + totals["a"].failed_scrapes == len({w[1] for w in want if w[0] == "a"})


def test_batches_that_are_repeated_change_nothing(spark, tmp_path):
    folder = str(tmp_path / "store")
    sources = spark.createDataFrame(list(ACTIVE.items()), "source string, is_active boolean")
    batches = [[r for r in drawn(5, 120) if r[1] == n] for n in range(4)]
    frames = [spark.createDataFrame(b, FOUND) for b in batches]

    def seen():
        return sorted(map(tuple, stream.committed(spark, folder, "tenders", FOUND).collect()), key=str)

    stream.apply_batch(frames[0], 0, sources, folder, FOUND)
    stream.apply_batch(frames[1], 1, sources, folder, FOUND)
    after = seen()
    stream.apply_batch(frames[1], 1, sources, folder, FOUND)  # again, after its ledger line
    assert seen() == after
    # A try that ended before its ledger line: its rows are there, but nobody sees them.
    frames[2].write.parquet(f"{folder}/tenders/batch=2")
    assert seen() == after
    stream.apply_batch(frames[2], 2, sources, folder, FOUND)
    want = one_after_another([r for b in batches[:3] for r in b], ACTIVE, [])
    assert seen() == sorted((w[:-1] for w in want if w[-1] == "created"), key=str)


def test_stream(spark, tmp_path):
    rows = drawn(9, 60)
    spark.createDataFrame(rows[:30], FOUND).write.parquet(str(tmp_path / "in"))
    sources = spark.createDataFrame(list(ACTIVE.items()), "source string, is_active boolean")
    folder, check = str(tmp_path / "store"), str(tmp_path / "check")

    def run():
        listed = spark.readStream.schema(FOUND).parquet(str(tmp_path / "in"))
        stream.scrape(listed, sources, folder, check).awaitTermination(120)
        return stream.committed(spark, folder, "tenders", FOUND).count(), stream.committed(spark, folder, "log", "source string, run int, status string, found long, done long, failed long, created long, error string").count()

    first = run()
    assert first == run() and first[0] == sum(w[-1] == "created" for w in one_after_another(rows[:30], ACTIVE, []))
    spark.createDataFrame(rows[30:], FOUND).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()[0] >= first[0]


def test_nothing(spark, tmp_path):
    sources = spark.createDataFrame([], "source string, is_active boolean")
    found = spark.createDataFrame([], FOUND)
    assert scraping.outcomes(found, sources, found.select("source", "lot_id")).count() == 0
    stream.apply_batch(found, 0, sources, str(tmp_path / "s"), FOUND)
    assert stream.committed(spark, str(tmp_path / "s"), "tenders", FOUND).count() == 0
    with pytest.raises(Exception):
        scraping.outcomes(found.drop("run"), sources, found).count()
