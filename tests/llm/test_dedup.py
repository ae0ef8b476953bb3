import hashlib

import numpy as np
import pytest

from tessera.llm import near_dedup, repeats
from tessera.llm.components import connected_components
from tessera.llm.hashing import shingle_sets, text_buffers
from tests.llm import corpus


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    data = corpus.rows()
    docs = spark.createDataFrame(data, corpus.SCHEMA).repartition(3)
    got = near_dedup.near_duplicates(docs, shingle_words=size, percent=80).documents.collect()
    want = corpus.near_components([(r[0], r[1]) for r in data], size, 80)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_many_near_copies_in_rounds(spark, monkeypatch):
    """Chains of copies that are linked step by step, with leaders picked over several rounds."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", 0.01)
    base = corpus.words(120, 9)
    texts = []
    for step in range(30):
        base = base[:]
        base[step * 4 % 120] = f"w{step}"
        texts.append(" ".join(base))
    data = list(enumerate(texts))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, shingle_words=2, percent=80).documents.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(corpus.near_components(data, 2, 80))


def test_near_duplicates_of_nothing(spark):
    docs = spark.createDataFrame([], corpus.SCHEMA)
    found = near_dedup.near_duplicates(docs)
    assert found.documents.count() == 0 and found.links.count() == 0


def test_shingle_sets_do_not_cross_documents():
    import pyarrow as pa

    texts = [r[1] for r in corpus.rows()]
    data, bounds = text_buffers(pa.array(texts))
    hashes, at = shingle_sets(data, bounds, 3)
    assert np.diff(at).tolist() == [len(corpus.shingles(t, 3)) for t in texts]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5), (100, 101)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_components_of_a_path_in_random_order(spark, monkeypatch):
    from tessera.llm import components

    rounds, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or write(df, name))
    order = np.random.default_rng(1).permutation(300).tolist()
    got = connected_components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert {r.label for r in got} == {0} and len(got) == 300
    assert rounds.count("labels-seen") <= 12


@pytest.mark.parametrize("length", [200, 60])
def test_repeats(spark, length):
    data = corpus.rows()
    docs = spark.createDataFrame(data, corpus.SCHEMA).repartition(3)
    got = repeats.remove_repeats(docs, length).collect()
    want = []
    for (key, text), mask in zip(((r[0], r[1]) for r in data), corpus.removed_masks([r[1] for r in data], length)):
        body = corpus.utf8(text)
        kept = bytes(b for b, m in zip(body, mask) if not m)
        runs = bytes(mask).replace(b"\x00", b" ").split()
        want.append((str(key), len(body), sum(mask), len(runs), hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_repeats_inside_one_document_and_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 7)  # many levels
    passage = " ".join(corpus.words(60, 31))
    data = [(i, " ".join(corpus.words(3 + i % 9, 500 + i)) + " " + passage[i % 40 :] + " " + " ".join(corpus.words(40, 900 + i))) for i in range(40)]
    data += [(99, "ab" * 400), (100, "z" * 199), (101, "z" * 200), (102, "z" * 201)]
    got = {r.doc_id: r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), 200).collect()}
    masks = corpus.removed_masks([t for _, t in data], 200)
    assert got == {key: sum(m) for (key, _), m in zip(data, masks)}


def test_repeats_of_hot_picks_and_long_texts(spark, monkeypatch):
    """Picks with many different units are counted by window, long texts are read in pieces."""
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "AT_ONCE", 700)
    passage = " ".join(corpus.words(60, 31))
    data = [(i, " ".join(corpus.words(3 + i, 500 + i)) + " " + passage[i % 9 :] + " " + " ".join(corpus.words(200, 900 + i))) for i in range(12)]
    data += [data[0], (None, "z" * 3000), (13, "z" * 201), (14, None)]
    got = sorted(r.n_removed for r in repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), 200).collect())
    assert got == sorted(sum(m) for m in corpus.removed_masks([t for _, t in data], 200))


def test_words_do_not_collide_by_structure():
    """Words whose hashes agree modulo a power of two under any sum of powers."""
    import pyarrow as pa

    for n in (64, 1024, 4096):
        morse = "".join("ab"[i.bit_count() % 2] for i in range(n))
        hashes, at = shingle_sets(*text_buffers(pa.array([morse, morse.translate(str.maketrans("ab", "ba"))])), 1)
        assert at.tolist() == [0, 1, 2] and hashes[0] != hashes[1]


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], corpus.SCHEMA)).count() == 0
