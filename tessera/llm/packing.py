"""Best-fit packing of token sequences by exact-complement hashing.

How pieces combine depends on their lengths alone, and there are at most ``capacity``
different lengths. So Spark counts pieces by length, one small plan is made from the
counts, and every piece finds its place from its rank among the pieces of its length.

The plan takes the longest length left and looks for what exactly fills its gap: one
length, else two, else three (indexes of single lengths and of pair sums, kept under
availability counts; a triple is a length and a pair). If none fits, it adds the longest
length that fits (best fit) and looks again. A combination is used as often as its
lengths last, so each step uses up a length and the plan has a few thousand entries
however many pieces there are.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import bounded_batches, written
from tessera.llm.tokens import WordEncoder


class _Stock:
    """Pieces left of each length, and which sums two different lengths left can make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.top = len(counts) - 1
        self.pair_sums = np.zeros(2 * self.top + 2, np.int64)
        present = np.flatnonzero(self.left)
        for i, a in enumerate(present):
            self.pair_sums[a + present[i + 1 :]] += 1

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0 and n:
            others = np.flatnonzero(self.left)
            self.pair_sums[length + others] -= 1

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of lengths left with this sum and the longest first member."""
        if total < 2:
            return None
        first = np.arange(min(total - 1, self.top), (total - 1) // 2, -1)
        first = first[(self.left[first] > 0) & (self.left[total - first] > 0)]
        for a in first[:2].tolist():
            if a * 2 != total or self.left[a] > 1:
                return a, total - a
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths left that add up to ``gap``."""
        if gap <= self.top and self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        first = np.arange(min(gap - 2, self.top), (gap - 1) // 3, -1)
        if not len(first):
            return None
        rest = gap - first
        twice = (rest % 2 == 0) & (self.left[np.minimum(rest // 2, self.top)] > 1)
        first = first[(self.left[first] > 0) & ((self.pair_sums[rest] > 0) | twice)]
        for a in first.tolist():
            self.left[a] -= 1
            found = self.pair(gap - a)
            self.left[a] += 1
            if found:
                return (a, *found)
        return None

    def longest(self, gap: int) -> int:
        """The longest length left of at most ``gap``; 0 if there is none."""
        found = np.flatnonzero(self.left[1 : min(gap, self.top) + 1])
        return int(found[-1]) + 1 if len(found) else 0


PLAN = ("length", "rank_lo", "per_sequence", "sequence_lo", "offset")


def plan_sequences(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows of PLAN, and the number of sequences; ``counts[n]`` is the number of pieces of length n.

    A row says: of the pieces of ``length``, those ranked from ``rank_lo`` on go
    ``per_sequence`` at a time into the sequences from ``sequence_lo`` on, at ``offset``.
    """
    stock, capacity = _Stock(counts), len(counts) - 1
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, ...]] = []
    sequences = 0
    length = capacity
    while length:
        if not stock.left[length]:
            length -= 1
            continue
        items, gap, found = [length], capacity - length, ()
        stock.left[length] -= 1
        while gap:
            found = stock.exact(gap) or ()
            if found:
                items += found
                break
            best = stock.longest(gap)
            if not best:
                break
            items.append(best)
            stock.left[best] -= 1
            gap -= best
        for x in items[: len(items) - len(found)]:  # what the search set aside
            stock.left[x] += 1
        needs = Counter(items)
        copies = min(int(stock.left[x]) // n for x, n in needs.items())
        at = 0
        for x, n in sorted(needs.items(), reverse=True):
            rows.append((x, int(used[x]), n, sequences, at))
            used[x] += n * copies
            stock.take(x, n * copies)
            at += x * n
        sequences += copies
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN)), sequences


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


def _cutter(tokenizer: str, end_id: int, capacity: int, keep_ids: bool) -> Callable:
    tail = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = WordEncoder.of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64).tolist()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 512):
                rows: list[tuple] = []
                for key, raw in zip(keys[at : at + 512], encoder.encode(batch.column(1).slice(at, 512).to_pylist()), strict=True):
                    raw += tail
                    for piece, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        ids = raw[lo : lo + 4 * capacity]
                        n = len(ids) // 4
                        rows.append((key, piece, lo // 4, n, zlib.crc32(ids), part, seen[n], *([ids] if keep_ids else [])))
                        seen[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"]
                columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return run


def _placer(plan: np.ndarray) -> Callable:
    length, rank_lo, per, sequence_lo, offset = plan.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = length * (1 << 44) + rank_lo
        for batch in batches:
            n, rank = (batch.column(name).to_numpy() for name in ("length", "rank"))
            row = np.searchsorted(order, n * (1 << 44) + rank, side="right") - 1
            turn = rank - rank_lo[row]
            placed = batch.drop_columns(["rank"])
            placed = placed.append_column("sequence_id", pa.array(sequence_lo[row] + turn // per[row]))
            yield placed.append_column("offset", pa.array(offset[row] + turn % per[row] * n))

    return run


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, key: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """Every document's pieces and their places in sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as
    little-endian unsigned 32-bit integers, with ``keep_ids``). Only documents longer than
    ``capacity`` are cut, into full pieces and a last one. Every document ends with
    ``end_id``, so a null or empty text is one piece of length 1. Null keys, ties and
    repeated rows are documents like others; an empty table gives no rows. Keys are whole
    numbers; other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = PIECES + (", ids binary" if keep_ids else "")
    pieces = written(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, keep_ids), schema), "pieces")
    by_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # a row a length: capacity rows at most
        counts[length] = n
    plan, _ = plan_sequences(counts)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kept = ranked.select(*names, "rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "rank")
    return kept.mapInArrow(_placer(plan), f"{schema}, sequence_id long, offset long")


def assemble(placed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed sequences of ``pack(..., keep_ids=True)``.

    A sequence has ``capacity`` pieces at most, so no group grows with the table.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda done, part: F.concat(done, part["ids"]))
    return placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"))
