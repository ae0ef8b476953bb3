"""Ranked search against scoring every document, and its early end."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import ranked
from tests.llm import corpus

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """docs, items: (key, text). Rows (item_id, rank, doc_id, score) by the whole formula."""
    listed = [(key, terms(text)) for key, text in docs]
    n_all, l_all = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    df = Counter(t for _, w in listed for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for key, w in listed:
            tf, score = Counter(w), 0
            for t in set(terms(text)):
                if tf[t]:
                    m = 10 + (90 * len(w) * n_all) // l_all
                    score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=10, partitions=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    q = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in ranked.ranked_search(d, q, k).collect()), key=str)


def hard():
    docs = [(r[0], r[1]) for r in corpus.rows()]
    docs += [(700, "Straße ÉCOLE école 12 a-b_c"), (701, "x" * 70 + " " + "x" * 71), (702, "x" * 70), (703, "ab \x01ab\x7fab"), (704, "one one ONE"), (705, "eightlet eightletter")]
    items = [(1, "One two; words"), (1, "One two; words"), (2, None), (3, "x" * 70), (4, "ab 12 straße École école"), (None, "eightlet one"), (5, "nowhere"), (6, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("k", [1, 10])
def test_hard_texts(spark, k):
    docs, items = hard()
    assert found(spark, docs, items, k) == plain(docs, items, k)


@pytest.mark.parametrize("shard,block,seeds", [(1, 1 << 18, 2), (7, 8, 1), (16, 64, 3)])
def test_shards_blocks_and_seeds(spark, monkeypatch, shard, block, seeds):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked, "SEED_EVERY", seeds)
    monkeypatch.setattr(ranked, "AT_ONCE", 64)
    rng = np.random.default_rng(5)
    word = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.4, n) % 60)
    docs = [(int(i), word(int(rng.integers(1, 40)))) for i in rng.permutation(150)] + [(200 + i, "w1 w2 w3") for i in range(30)]
    items = [(i, word(6)) for i in range(12)] + [(50, "w1 w2 w3")]
    assert found(spark, docs, items, 5, 4) == plain(docs, items, 5)


def test_search_ends_before_all_postings(monkeypatch):
    """A rare term decides; of the common one only the groups that can matter are processed."""
    n = 4000
    row = {"ids": np.arange(n, dtype="<i8").tobytes(), "no_id": bytes(n), "lengths": np.full(n, 100, "<i8").tobytes()}
    rare = np.arange(n) % 400 == 0
    row["bounds"] = np.concatenate(([0], np.cumsum(1 + rare))).astype("<i8").tobytes()
    row["terms"] = np.concatenate([[0, 1] if r else [0] for r in rare]).astype("<i4").tobytes()
    row["counts"] = np.concatenate([[1 + i % 3, 5] if r else [1 + i % 3] for i, r in enumerate(rare)]).astype("<i8").tobytes()
    shard = ranked.Shard(row, np.array([1, 9000]), n, 100 * n)
    docs, scores = shard.search(np.array([0, 1]), 5, 0)
    assert set(docs) <= set(np.flatnonzero(rare)) and len(docs) >= 5
    whole = np.zeros(n, np.int64)
    np.add.at(whole, np.repeat(np.arange(n), 1 + rare), shard.impacts)
    assert (scores == whole[docs]).all() and sorted(scores)[-5:] == sorted(whole)[-5:]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(ranked, "word_hashes", lambda data, lo, hi: np.zeros(len(lo), np.uint64))
    known = [b"aa", b"ab", b"abcdefghi", b"abcdefghj", b"y" * 80, b"z" * 80]
    texts = [*known, b"b", b"abcdefgh", b"y" * 79 + b"z"]
    out = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.concatenate(([0], np.flatnonzero(out == 0x20) + 1))
    assert ranked.Vocabulary(known).find(out, starts).tolist() == [0, 1, 2, 3, 4, 5, -1, -1, -1]


def test_nothing(spark):
    assert found(spark, [], [(1, "a")]) == [] and found(spark, [(1, "a")], []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    items = spark.createDataFrame([(1, "one", 3)], "item_id long, text string, doc_id int")
    assert [r.doc_id for r in ranked.ranked_search(docs, items).collect()][:2] == [6, 7]
