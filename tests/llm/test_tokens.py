import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_files
from tessera.llm.scratch import new_path
from tessera.llm.tokens import WordEncoder
from tests.llm import corpus

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_encode_as_whole_texts(ids):
    texts = [r[1] for r in corpus.rows()] + ["it's 12.5%", "ŒſßİΣς Ǆ", "á ́b c　d", "a\x00b"]
    encoder = WordEncoder(PATH)
    for _ in range(2):  # the second time from the store
        for text, raw in zip(texts, encoder.encode(texts)):
            assert raw == ids(text)[:-1].tobytes()


def test_elias_fano_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 0), (1, 0), (1, 10**6), (500, 500), (1000, 10**7), (300, 40)):
        values = np.sort(rng.integers(0, top + 1, n))
        code = token_files.EliasFano.of(values, top)
        assert code.all().tolist() == values.tolist()
        assert [code.select(i) for i in range(n)] == values.tolist()


def test_block_round_trip():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 1, 0, 500)]
    block = token_files.Block.of(token_files.encode_block([5, None, -2, 9], ids, 2))
    assert [block.document(i).tolist() for i in range(4)] == [list(range(n)) for n in (3, 1, 0, 500)]
    with pytest.raises(ValueError):
        token_files.Block.of(b"XXXX" + bytes(40))


def test_token_files(spark, ids):
    data = corpus.rows()
    docs = spark.createDataFrame(data, corpus.SCHEMA).repartition(3)
    path = new_path(spark, "test")
    token_files.write_token_files(docs, path, PATH)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_index(spark, path).collect()))
    assert [g[1] for g in got] == sorted((r[0] for r in data), key=lambda k: (k is not None, k))
    assert got[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))
    want = sorted((str(r[0]), len(ids(r[1])), zlib.crc32(ids(r[1]).tobytes())) for r in data)
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], corpus.SCHEMA)
    path = new_path(spark, "test")
    token_files.write_token_files(docs, path, PATH)
    assert token_files.read_token_index(spark, path).count() == 0
    assert packing.pack(docs, PATH).count() == 0


def test_packing(spark, ids):
    data = corpus.rows()
    docs = spark.createDataFrame(data, corpus.SCHEMA).repartition(3)
    placed = packing.pack(docs, PATH, capacity=512, keep_ids=True)
    rows = placed.collect()
    want = []
    for key, text in ((r[0], r[1]) for r in data):
        x = ids(text)
        want += [(str(key), lo // 512, lo, len(x[lo : lo + 512]), zlib.crc32(x[lo : lo + 512].tobytes())) for lo in range(0, len(x), 512)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 512
    total = sum(sequences.values())
    assert len(sequences) <= -(-total // 512) + 1
    whole = packing.assemble(placed).collect()
    assert {r.sequence_id: len(r.ids) // 4 for r in whole} == sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    counts = np.bincount(rng.integers(1, capacity + 1, int(rng.integers(1, 300))), minlength=capacity + 1)
    plan, sequences = packing.plan_sequences(counts)
    fill = Counter_()
    for length in range(1, capacity + 1):
        for rank in range(counts[length]):
            row = [p for p in plan if p[0] == length and p[1] <= rank][-1]
            turn = rank - row[1]
            fill.add(row[3] + turn // row[2], row[4] + turn % row[2] * length, length)
    assert fill.check(sequences, capacity)


class Counter_:
    def __init__(self):
        self.places = {}

    def add(self, sequence, offset, length):
        self.places.setdefault(int(sequence), []).append((int(offset), int(length)))

    def check(self, sequences, capacity):
        assert sorted(self.places) == list(range(sequences))
        for pieces in self.places.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        return True


def test_ids_equal_the_library_on_odd_characters():
    import random

    encoder = WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    parts = ["a", "B", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\t", "\u3000", "\u00e9", "\x85", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "the", "I", "\u0307", "\u0301", "1", "-", "\ufeff"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, raw in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_select_finds_every_boundary():
    rng = np.random.default_rng(3)
    for gaps in ([1] * 500, rng.integers(0, 5000, 700), [1] * 100 + [100_000] + [1] * 100):
        ends = np.cumsum(gaps)
        code = token_files.EliasFano.of(ends, int(ends[-1]))
        assert [code.select(i) for i in range(len(ends))] == ends.tolist() == code.all().tolist()
