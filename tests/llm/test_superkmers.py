"""Removal of repeated windows of words against counting every window."""

import hashlib

import numpy as np
import pytest

from tessera.llm import superkmers
from tests.llm import corpus


def plain(data, window):
    """(key, n_words, n_removed, kept_sha256) by looking at every window; data: (key, text)."""
    order = lambda key: float("inf") if key is None else key
    texts = [(key, corpus.utf8(text).split()) for key, text in data]
    first = {}
    for key, w in texts:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, float("inf")), order(key))
    out = []
    for key, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(key):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, data, window, schema="doc_id long, text string"):
    docs = spark.createDataFrame(data, schema).repartition(3)
    return sorted((tuple(r) for r in superkmers.remove_windows(docs, window).collect()), key=str)


@pytest.mark.parametrize("window", [50, 12, 3])
def test_hard_texts(spark, window):
    data = corpus.rows()
    data += [(900 + i, t, "en", "s", 1, "n", 1, 2) for i, t in enumerate(["w " * 700, "w " * 900 + "x", "\t".join(["w"] * 60), "Ab\x01 " * 55, "a\x0bb\x0cc\r" * 30])]
    data.append((903, data[0][1] + " tail", "en", "s", 1, "n", 1, 2))
    assert found(spark, data, window, corpus.SCHEMA) == plain([(r[0], r[1]) for r in data], window)


@pytest.mark.parametrize("part", [1, 2, 39, 40, 41])
def test_hot_passage(spark, monkeypatch, part):
    """One passage with other surroundings in every document: buckets in several parts, and just not."""
    monkeypatch.setattr(superkmers, "PART", part)
    passage = corpus.words(40, 1)
    data = [(i * 7 % 41, " ".join(corpus.words(30, 100 + i) + passage + corpus.words(30, 200 + i))) for i in range(40)]
    data += [(None, " ".join(passage)), (50, " ".join(passage[5:])), (51, " ".join(passage * 3))]
    assert found(spark, data, 20) == plain(data, 20)


def test_blocks_and_sorted_batches(spark, monkeypatch):
    """Long texts in pieces, long super-k-mers in several strings, buckets sorted a few at a time."""
    monkeypatch.setattr(superkmers, "SORTED_WORDS", 100)
    monkeypatch.setattr(superkmers, "MOST_WINDOWS", 7)
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 4, 3000)]
    data = [(i, " ".join(base[i * 100 : i * 100 + 900])) for i in range(20)]
    data += [(30, " ".join(["q" * 100, *base[:60], "r" * 5000] * 3)), (31, " ".join(["q" * 100, *base[:60], "r" * 5000]))]
    assert found(spark, data, 50) == plain(data, 50)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "AT_ONCE", 8000)
    long = " ".join(corpus.words(9_000, 8))
    data = [(2, long), (1, long[10_000:30_000]), (3, "  " + long + " more"), (4, "y" * 40_000)]
    assert found(spark, data, 50) == plain(data, 50)


def test_nothing(spark):
    docs = spark.createDataFrame([], corpus.SCHEMA)
    assert superkmers.remove_windows(docs).collect() == []
    assert found(spark, [(1, None), (2, ""), (None, " \n")], 5) == plain([(1, None), (2, ""), (None, " \n")], 5)


def test_window_ranks_are_exact():
    words = np.random.default_rng(0).integers(0, 2, 500)
    for window in (1, 2, 3, 5, 8, 50):
        rank = superkmers.window_ranks(words, window)
        seen = {}
        for i, r in enumerate(rank.tolist()):
            assert seen.setdefault(r, tuple(words[i : i + window])) == tuple(words[i : i + window])
        assert len(seen) == len({tuple(words[i : i + window]) for i in range(len(words) - window + 1)})
