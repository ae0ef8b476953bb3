"""The audit against evaluating every term of every group and pair."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence
from tests.llm import corpus

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, k=200, least_docs=3):
    """docs: (lang, source, text) rows."""
    docs = [(a or "", b or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in docs]
    held, group, lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for a, b, w in docs:
        held[a].update(set(w))
        group[a, b].update(w)
        lang[a].update(w)
    out = []
    for (a, b), own in group.items():
        kept = [t for t, n in held[a].items() if n >= least_docs]
        v = len(kept)

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 1)) // (n + v) for t in kept}

        f = lambda x, y: (x - y) ** 2 // y
        mine, q = p(own), p(lang[a])
        pairs = []
        for (c, d), theirs in group.items():
            if c == a and d != b:
                other = p(theirs)
                pairs.append((-sum(f(mine[t], other[t]) for t in kept), d.encode()))
        terms = [(-f(mine[t], q[t]), t.encode()) for t in kept if own[t] and mine[t] > q[t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, k)):
            out += [(a, b, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def found(spark, docs, k=200, least_docs=3):
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, k, least_docs).collect())


def random_docs(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcÉß"), rng.integers(1, 4)))
    words = [word() for _ in range(80)]
    text = lambda shift: " ".join(words[int(x + shift) % 80] for x in rng.zipf(1.3, rng.integers(0, 60)) % 1000)
    return [(["en", "de", None][i % 3], f"s{int(rng.integers(0, 7))}", text(i % 5)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7, 200])
def test_random_documents(spark, k):
    docs = random_docs(250, 4)
    assert found(spark, docs, k) == plain(docs, k)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTS", 50)
    monkeypatch.setattr(divergence, "POSTINGS", 40)
    monkeypatch.setattr(divergence, "PAIRS", 30)
    monkeypatch.setattr(divergence, "AT_ONCE", 30)
    docs = random_docs(120, 9)
    assert found(spark, docs, 5) == plain(docs, 5)


def test_hard_texts(spark):
    docs = [(r[2], r[3], r[1]) for r in corpus.rows()]
    docs += [("en", "src0", "Ab1cd\x01ef ÉÉ Éé"), ("xx", "a", None), ("xx", "b", ""), ("yy", "only", "word " * 5), ("", None, "b b b"), (None, "", "b"), (None, "z", "b c"), (None, "y", "c c"), (None, "y", "C")]
    assert found(spark, docs) == plain(docs)
    assert found(spark, docs, least_docs=1) == plain(docs, least_docs=1)


def test_ties_are_ranked_by_item(spark):
    docs = [("en", s, " ".join(chr(97 + i) * 2 for i in range(20)) + (" zz" * 9 if s == "a" else "")) for s in "abab"]
    assert found(spark, docs, 3) == plain(docs, 3)
    assert found(spark, [("en", s, " ".join([s + chr(97 + i) for i in range(20)])) for s in "aabb"], 3, 2) == plain([("en", s, " ".join([s + chr(97 + i) for i in range(20)])) for s in "aabb"], 3, 2)


def test_nothing(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA).withColumnRenamed("node", "term").withColumnRenamed("_cell", "n")
    assert divergence.audit(docs).count() == len(plain([(r[2], r[3], r[1]) for r in corpus.rows()]))
