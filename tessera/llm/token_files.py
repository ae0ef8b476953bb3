"""Token-id files: blocks of concatenated ids with Elias-Fano document boundaries.

A block is one binary value (all integers little-endian)::

    magic "TEF1" | n_docs u32 | n_ids u64 | low_bits u8 | id_width u8 | 2 zero bytes | n_high u32
    | low parts of the boundaries | high parts | rank samples | doc ids | token ids

The n_docs end positions form a rising sequence below n_ids + 1. Its Elias-Fano code
keeps the ``low_bits`` lowest bits of each packed, and the rest in unary: bit
``(end >> low_bits) + i`` is set for the i-th end. ``select(i)`` finds that bit from
sampled positions of every 64th set bit and a popcount scan, so any document's offset
comes back without a table of 64-bit offsets: about ``2 + log2(n_ids / n_docs)`` bits a
document. Ids take two bytes where the vocabulary allows and four otherwise.

Blocks are rows of a Parquet table (partition, block, first position inside the
partition, payload), written by Spark's own committed writer: a lost executor's task is
run again, and the files live wherever Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches
from tessera.llm.tokens import WordEncoder

MAGIC = b"TEF1"
HEAD = struct.Struct("<4sIQBB2xI")
#: Set bits between two samples of the select structure.
SAMPLE = 64
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Documents after which a block is closed.
BLOCK_DOCS = 1 << 14
NO_ID = -(1 << 63)

BLOCKS = "part int, block int, first_id long, n_ids long, n_docs long, payload binary"


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The ``width`` lowest bits of each value, one after another, lowest bit first."""
    if width == 0 or len(values) == 0:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, count: int, width: int) -> np.ndarray:
    if width == 0 or count == 0:
        return np.zeros(count, np.uint64)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little")
    return bits.reshape(count, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


@dataclass
class EliasFano:
    """A non-decreasing sequence of n values up to ``top``."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @staticmethod
    def of(values: np.ndarray, top: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (int(top) // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        samples = places[::SAMPLE].astype("<u4").tobytes()
        return EliasFano(n, low_bits, pack_bits(values, low_bits), np.packbits(high, bitorder="little").tobytes(), samples)

    def select(self, i: int) -> int:
        """The i-th value: set bits are counted from the nearest sample on, 32 bytes at a time."""
        start = struct.unpack_from("<I", self.samples, 4 * (i // SAMPLE))[0]
        want, byte = i % SAMPLE, start // 8
        bits = int.from_bytes(self.high[byte : byte + 32], "little") >> (start % 8) << (start % 8)
        while (n := bits.bit_count()) <= want:
            want, byte = want - n, byte + 32
            bits = int.from_bytes(self.high[byte : byte + 32], "little")
        half, shift = 128, 0
        while half:  # the half that holds the bit wanted
            low = (bits >> shift) & ((1 << half) - 1)
            if (n := low.bit_count()) <= want:
                want, shift = want - n, shift + half
            half //= 2
        place = 8 * byte + shift
        at = i * self.low_bits
        window = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 15) // 8], "little")
        low = (window >> (at % 8)) & ((1 << self.low_bits) - 1)
        return ((place - i) << self.low_bits) | low

    def all(self) -> np.ndarray:
        """Every value, by one pass over both parts."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        places = np.flatnonzero(bits)[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return (high | unpack_bits(self.low, self.n, self.low_bits)).astype(np.int64)


def encode_block(doc_ids: list[int | None], ids: list[bytes], id_width: int) -> bytes:
    """``ids``: for each document its ids as little-endian unsigned 32-bit integers."""
    ends = np.cumsum([len(b) // 4 for b in ids], dtype=np.int64) if ids else np.zeros(0, np.int64)
    n_ids = int(ends[-1]) if len(ends) else 0
    bounds = EliasFano.of(ends, n_ids)
    wide = np.frombuffer(b"".join(ids), "<u4")
    if id_width < 4 and len(wide) and int(wide.max()) >> (8 * id_width):
        raise ValueError(f"an id of {int(wide.max())} needs more than {id_width} bytes")
    tokens = wide.astype(f"<u{id_width}").tobytes()
    keys = np.array([NO_ID if d is None else d for d in doc_ids], "<i8").tobytes()
    head = HEAD.pack(MAGIC, bounds.n, n_ids, bounds.low_bits, id_width, len(bounds.high))
    return b"".join((head, bounds.low, bounds.high, bounds.samples, keys, tokens))


@dataclass
class Block:
    """A decoded view of a payload; ids are sliced out on demand."""

    bounds: EliasFano
    doc_ids: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def of(payload: bytes) -> Block:
        magic, n, n_ids, low_bits, width, n_high = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = HEAD.size

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return payload[at - size : at]

        low, high = take((n * low_bits + 7) // 8), take(n_high)
        samples = take(4 * ((n + SAMPLE - 1) // SAMPLE))
        keys = np.frombuffer(take(8 * n), "<i8")
        tokens = np.frombuffer(payload, f"<u{width}", n_ids, at)
        return Block(EliasFano(n, low_bits, low, high, samples), keys, tokens)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by two selects."""
        lo = self.bounds.select(i - 1) if i else 0
        return self.tokens[lo : self.bounds.select(i)]


def _writer(tokenizer: str, end_id: int, id_width: int):
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        block = first = size = 0
        keys: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, size, keys, held
            row = [[part], [block], [first], [size], [len(keys)], [encode_block(keys, held, id_width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], ["part", "block", "first_id", "n_ids", "n_docs", "payload"])
            block, first, size, keys, held = block + 1, first + size, 0, [], []
            return out

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 512):
                for key, raw in zip(ids[at : at + 512], encoder.encode(texts.slice(at, 512).to_pylist()), strict=True):
                    keys.append(key)
                    held.append(raw + tail)
                    size += len(raw) // 4 + 1
                    if size >= BLOCK_IDS or len(keys) >= BLOCK_DOCS:
                        yield close()
        if keys:
            yield close()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_width: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text, plus ``end_id`` each, in ascending ``key`` order.

    Parts follow each other in key order (null keys first); rows with one key follow in the
    order of a hash of their text, which also lets a key with any share of the rows spread
    over parts. A null or empty text is its end id alone. ``key`` is a whole number (the
    smallest long is kept for null). ``id_width`` is 2 for vocabularies up to 65,536 ids,
    else 4. An empty table gives an empty folder.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie)
    ordered.mapInArrow(_writer(tokenizer, end_id, id_width), BLOCKS).write.parquet(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, firsts, payloads = (batch.column(i) for i in range(3))
        for part, first, payload in zip(parts.to_pylist(), firsts.to_pylist(), payloads, strict=True):
            block = Block.of(payload.as_py())
            ends = np.array([block.bounds.select(i) for i in range(block.bounds.n)], np.int64)
            starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
            wide = block.tokens.astype("<u4")
            sums = [zlib.crc32(wide[lo:hi]) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.doc_ids, pa.int64(), mask=block.doc_ids == NO_ID),
                    pa.array(np.full(len(ends), part, np.int32)),
                    pa.array(starts + first),
                    pa.array(ends - starts),
                    pa.array(sums, pa.int64()),
                ],
                ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` counts all ids before the document: its place inside its part, plus the ids of
    all parts before. The sums by part are one row a part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    found = blocks.select("part", "first_id", "payload").mapInArrow(_reader, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = found.join(offsets, "part")
    return joined.select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
