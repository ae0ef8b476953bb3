"""Exact repeats by a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Four
steps find all such strings without comparing documents with each other:

1. Units. Every window of ``length`` bytes picks the ``GRAM``-byte string inside it with the
   smallest hash. Equal windows pick the same string at the same place, so neighbouring
   windows with one pick form a unit, and only units with equal picks can share a window.
2. Candidates. Units are counted by their pick's hash; the others are unique text and leave.
   Equal units become one with a count.
3. Index family, in each task for the picks dealt to it. A batch of units gets a (sparse) suffix
   array: the suffixes from the picks on, sorted, so that those with one pick form a run. One
   merge scan goes over the batch and all levels; in a run that the batch adds to, longest common
   prefixes of suffixes and longest common suffixes of what stands before them tell which
   windows are equal. Then the batch becomes a level, and levels of equal size class merge, so n
   batches make about log n levels. The number of tasks follows the number of units.
4. Equal windows go back to their documents, are united into spans, and are cut.

Identical documents collapse in step 2, and so do copies of a passage with the same
surroundings; counts travel, rows don't multiply. A pick with more than ``HOT`` different units
(a passage with other surroundings in every document) would not fit one task's index: its
windows are dealt out by their own digests instead and counted, so that the class of equal
windows is the key and is summed before it is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import mix, slices, text_buffers, window_hashes
from tessera.llm.scratch import bounded_batches, small, written

GRAM = 32
#: Bytes looked at at once, about, and the bits that number places in them and a little more.
AT_ONCE, PLACE_BITS = 1 << 19, 22
#: Units in a batch of the index family, and in one task's family, about.
BATCH, UNITS_PER_TASK = 1 << 14, 1 << 17
#: Different units of one pick up to which the family compares them.
HOT = 1 << 13


def units(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """pick, print, first, windows, shift and document of every unit, in document order.

    ``pick`` hashes the picked string and ``print`` all bytes of the unit; ``first`` is its first
    window's start in the document, ``windows`` their number, ``shift`` the pick's place.
    """
    n, span = len(data), length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    at = np.arange(n - GRAM + 1)
    grams = window_hashes(data, GRAM)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    # Smallest of each `span` neighbours: minima from both ends of blocks. The place is in
    # the low bits, so the leftmost of equal hashes wins in every document alike.
    full = -(-len(grams) // span) * span
    keyed = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    keyed[: len(grams)] = (grams & ~mask) | at.astype(np.uint64)
    table = keyed.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    pick = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & mask).astype(np.int64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:starts]
    inside = np.arange(starts) + length <= bounds[1:][owner]
    pick[~inside] = -1
    new = np.ones(starts, bool)
    new[1:] = (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, starts))
    real = pick[first] >= 0
    first, windows = first[real], windows[real]
    pick, owner = pick[first], owner[first]
    shift = pick - first
    return grams[pick], _prints(grams, first, windows - 1 + length, shift), first - bounds[owner], windows, shift, owner


def _prints(grams: np.ndarray, first: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """A hash of ``size`` bytes from ``first`` on, made of the hashes of GRAM bytes after GRAM bytes."""
    step = np.uint64(0xD1342543DE82EF95)
    out = mix(size.astype(np.uint64) * step + shift.astype(np.uint64))
    for k in range(0, int(size.max(initial=0)) - GRAM + 1, GRAM):
        live = np.flatnonzero(size >= k + GRAM)
        out[live] = mix(out[live] * step + grams[first[live] + k])
    return mix(out * step + grams[first + size - GRAM])


def units_of_long(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """units() of one long text, from pieces that share ``length - 1`` bytes with the next one."""
    parts = []
    for lo in range(0, len(data) - length + 1, AT_ONCE):
        body = data[lo : lo + AT_ONCE + length - 1]
        pick, prints, first, windows, shift, owner = units(body, np.array([0, len(body)]), length)
        parts.append((pick, prints, first + lo, windows, shift, owner))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _unit_finder(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column(0))
            for i, j in slices(bounds, AT_ONCE):
                body, ends = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                found = units(body, ends, length) if len(body) <= 2 * AT_ONCE else units_of_long(body, length)
                pick, prints, first, windows, shift, owner = found
                raw = body.tobytes()
                keys = [hashlib.md5(raw[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                offsets = pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32))
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(x))
                    for x in (pick.view(np.int64), prints.view(np.int64), first.astype(np.int32), windows.astype(np.int32), shift.astype(np.int32))
                ]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *lists], ["text_key", "pick", "print", "first", "windows", "shift"])

    return run


def _unit_reader(length: int) -> Callable:
    """The bytes of the units wanted of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            rows: list[tuple] = []
            for text, wanted in zip(texts, batch.column(1).to_pylist(), strict=True):
                text = text.as_py() or b""
                for w in wanted:
                    body = text[w["first"] : w["first"] + w["windows"] - 1 + length]
                    rows.append((w["pick"], w["print"], w["shift"], w["n"], body))
                if len(rows) > 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        columns = [pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["pick", "print", "shift", "n", "body"])

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Unit:
    """A unit's suffix from its pick on, what stands before it (reversed), and its found windows."""

    __slots__ = ("after", "before", "found", "fresh", "label")

    def __init__(self, label: tuple[int, int], body: bytes, shift: int, windows: int, repeated: bool):
        self.label = label
        self.after = body[shift:]
        self.before = body[:shift][::-1]
        self.found = np.full(windows, repeated)
        self.fresh = True


def match_run(run: list[Unit], length: int) -> None:
    """Mark the equal windows of units with one pick, sorted by suffix.

    A window with ``a`` bytes before the pick equals another's with as many if both the
    ``length - a`` bytes after and the ``a`` before are equal. Along the sorted suffixes,
    common prefixes of neighbours cut the run into classes for every length; along the
    sorted reversed texts before, so do common suffixes.
    """
    m = len(run)
    if m == 2:
        x, y = run
        before, after = common_prefix(x.before, y.before), common_prefix(x.after, y.after)
        for u in run:  # window i has len(u.before) - i bytes before the pick
            lo, hi = len(u.before) - before, len(u.before) - (length - after)
            if hi >= lo:
                u.found[max(lo, 0) : hi + 1] = True
        return
    after = np.array([common_prefix(x.after, y.after) for x, y in zip(run, run[1:])])
    order = sorted(range(m), key=lambda i: run[i].before)
    before = np.array([common_prefix(run[i].before, run[j].before) for i, j in zip(order, order[1:])])
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    most = np.array([len(u.before) for u in run])
    least = most - np.array([len(u.found) for u in run]) + 1
    steps = max(1, (1 << 21) // m)
    for lo in range(int(least.min()), int(most.max()) + 1, steps):
        a = np.arange(lo, min(lo + steps, int(most.max()) + 1))
        right = np.zeros((len(a), m), np.int64)
        np.cumsum(after[None, :] < (length - a)[:, None], axis=1, out=right[:, 1:])
        left = np.zeros((len(a), m), np.int64)
        np.cumsum(before[None, :] < a[:, None], axis=1, out=left[:, 1:])
        kind = (right * m + left[:, place]) + (a - lo)[:, None] * (m * m)
        has = (a[:, None] >= least) & (a[:, None] <= most)
        row, unit = np.nonzero(has)
        _, spot, count = np.unique(kind[has], return_inverse=True, return_counts=True)
        for i, u in zip((a[row] if len(row) else row)[count[spot] > 1].tolist(), unit[count[spot] > 1].tolist(), strict=True):
            run[u].found[most[u] - i] = True


_after = attrgetter("after")


class IndexFamily:
    """Levels of sorted suffixes whose sizes grow geometrically."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[list[Unit]] = []

    def add(self, batch: list[Unit]) -> None:
        batch.sort(key=_after)  # the batch's suffix array
        scan = heapq.merge(batch, *self.levels, key=_after) if self.levels else batch
        for _, run in groupby(scan, key=lambda u: u.after[:GRAM]):
            met = list(run)
            if len(met) > 1 and any(u.fresh for u in met):
                match_run(met, self.length)
        for u in batch:
            u.fresh = False
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            top = self.levels.pop()
            self.levels[-1] = list(heapq.merge(self.levels[-1], top, key=_after))


def _indexer(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, fresh = IndexFamily(length), []
        for batch in batches:
            for pick, mark, shift, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fresh.append(Unit((pick, mark), body, shift, len(body) - length + 1, n > 1))
            if len(fresh) >= BATCH:
                family.add(fresh)
                fresh = []
        if fresh:
            family.add(fresh)
        rows: list[tuple] = []
        for level in family.levels:
            for u in level:
                if u.found.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], u.found, [False])).astype(np.int8)))
                    rows.append((*u.label, edge[::2].astype(np.int32), edge[1::2].astype(np.int32)))
        names = ["pick", "print", "lo", "hi"]
        for i in range(0, len(rows), 8192):
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows[i : i + 8192], strict=True), kinds, strict=True)], names)

    return run


def _window_lister(length: int) -> Callable:
    """Every window of the units wanted of each text, with a digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["pick", "print", "at", "n", "key"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            for text, wanted in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                for w in wanted:
                    m, first = w["windows"], w["first"]
                    keys = [hashlib.blake2b(text[k : k + length], digest_size=16).digest() for k in range(first, first + m)]
                    columns = [[w["pick"]] * m, [w["print"]] * m, range(m), [w["n"]] * m, keys]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _hot_matches(docs: DataFrame, text: str, distinct: DataFrame, length: int) -> DataFrame:
    """What the index family gives, for units of picks that have too many: by counting equal windows."""
    wanted = written(_by_text(distinct), "hot-units")
    read = _bodies(docs, text, wanted).join(wanted, "text_key").select("text", "wanted")
    windows = written(read.mapInArrow(_window_lister(length), "pick long, print long, at int, n long, key binary"), "hot-windows")
    repeated = written(windows.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "hot-repeats")
    found = windows.join(small(repeated), "key").groupBy("pick", "print").agg(F.collect_set("at").alias("at"))
    edge = lambda step: F.array_sort(F.filter("at", lambda i: ~F.array_contains("at", i + step)))
    return found.select("pick", "print", edge(-1).alias("lo"), F.transform(edge(1), lambda i: i + 1).alias("hi"))


def _by_text(distinct: DataFrame) -> DataFrame:
    unit = F.struct("pick", "print", "n", "at.first", "at.windows", "at.shift")
    return distinct.groupBy("at.text_key").agg(F.collect_list(unit).alias("wanted"))


def text_key(text: Column) -> Column:
    """md5 of a text's bytes; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _bodies(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """text_key and text of each distinct text with a key in the written table ``wanted``.

    Few keys are sent to the documents; many are met in the join that follows.
    """
    bodies = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return bodies.join(small(wanted.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"])


def repeated_spans(docs: DataFrame, length: int = 200, text: str = "text") -> DataFrame:
    """text_key, spans: for each distinct text with repeats, the byte ranges [lo, hi) to remove.

    ``spans`` (array of struct lo, hi) are as found: they may touch or overlap.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    arrays = "text_key binary, pick array<long>, print array<long>, first array<int>, windows array<int>, shift array<int>"
    found = written(texts.mapInArrow(_unit_finder(length), arrays), "units")
    # Written, so that a join with it is dealt out anew and Spark can split a hot pick.
    shared = found.select(F.explode("pick").alias("pick")).groupBy("pick").agg(F.count("*").alias("n")).filter("n > 1").select("pick")
    shared = written(shared, "shared-picks")
    unit = F.explode(F.arrays_zip("pick", "print", "first", "windows", "shift")).alias("u")
    single = found.select("text_key", unit).select("text_key", "u.*")
    candidates = written(single.join(small(shared), "pick"), "unit-candidates")
    where = F.struct("text_key", "first", "windows", "shift")
    distinct = written(candidates.groupBy("pick", "print").agg(F.count("*").alias("n"), F.min(where).alias("at")), "units-distinct")
    hot = written(distinct.groupBy("pick").agg(F.count("*").alias("units")).filter(F.col("units") > HOT).select("pick"), "hot-picks")
    any_hot = hot.count() > 0
    cold = distinct.join(small(hot), "pick", "left_anti") if any_hot else distinct
    wanted = written(_by_text(cold), "units-wanted")
    read = _bodies(docs, text, wanted).join(wanted, "text_key").select("text", "wanted").mapInArrow(_unit_reader(length), "pick long, print long, shift int, n long, body binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), distinct.count() // UNITS_PER_TASK + 1)
    matched = read.repartition(tasks, "pick").mapInArrow(_indexer(length), "pick long, print long, lo array<int>, hi array<int>")
    if any_hot:
        matched = matched.unionByName(_hot_matches(docs, text, distinct.join(small(hot), "pick"), length))
    spans = candidates.select("text_key", "pick", "print", "first").join(matched, ["pick", "print"])
    spans = spans.select("text_key", F.explode(F.arrays_zip("lo", "hi")).alias("s"), "first")
    spans = spans.select("text_key", F.struct((F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi") + (length - 1)).alias("hi")).alias("span"))
    return written(spans.groupBy("text_key").agg(F.array_sort(F.collect_set("span")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans united where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["lo"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["hi"]))
        else:
            out.append((s["lo"], s["hi"]))
    return out


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            text, gone, at, kept = text.as_py(), merged(spans.as_py()), 0, []
            for lo, hi in gone:
                kept.append(text[at:lo])
                at = hi
            rest = b"".join([*kept, text[at:]])
            rows.append((key.as_py(), len(text) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["text_key", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def cut(docs: DataFrame, spans: DataFrame, text: str = "text") -> DataFrame:
    """text_key, n_removed, n_spans, kept_sha256, kept_text of each distinct text with repeats.

    ``kept_text`` leaves out the parts of characters that a cut has split.
    """
    bounded_batches(docs.sparkSession)
    joined = _bodies(docs, text, spans).join(spans, "text_key").select("text_key", "text", "spans")
    return joined.mapInArrow(_cutter, "text_key binary, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    Every byte covered by a ``length``-byte string that also starts elsewhere in ``docs`` goes,
    all copies of it; matches never cross documents. Null and empty texts have no bytes; equal
    texts (repeated rows too) of at least ``length`` bytes go whole; an empty table gives no
    rows. Other columns play no part.
    """
    changed = cut(docs, repeated_spans(docs, length, text), text).drop("kept_text")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), text_key(F.col(text)).alias("text_key"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole"))
    out = rows.join(changed, "text_key", "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
