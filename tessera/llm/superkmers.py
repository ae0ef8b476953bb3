"""Repeated windows of words, by super-k-mers dealt to the buckets of their minimisers.

A word goes if a window of ``window`` consecutive words that covers it also starts in a document
with a smaller doc_id. Windows are never listed one by one over all texts:

1. Super-k-mers. Every window has a minimiser, the smallest hash of the ``GRAM`` consecutive words
   in it. Neighbouring windows with one minimiser are a super-k-mer: w windows in one string of
   w + window - 1 words. Equal windows have equal minimisers, so they meet in one bucket.
2. A minimiser that only one text has holds no repeat. The others' super-k-mers are counted by
   print; equal ones become one with the smallest doc_id that has it. A bucket left with a single
   string is settled: all its windows first stand in that document.
3. Buckets. The other strings travel packed to the bucket of their minimiser. There the words get
   numbers, and sorting pairs of ranks of 1, 2, 4 ... words gives equal windows, and only these,
   one rank; the smallest doc_id of a rank is where its window first stands.
4. A minimiser with more than ``PART`` different strings (a passage with other surroundings in
   every document) is a bucket in several parts by print. Each part is sorted alike; the windows'
   first documents in the parts are then merged by a digest of the window.
5. First documents go back to the texts that have the string; where they come before the text's
   own, the windows' words are cut.

Texts that are equal are read once, with the smallest doc_id; the others lose everything if they
have a whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.hashing import mix, slices, text_buffers, word_hashes
from tessera.llm.repeats import text_key
from tessera.llm.scratch import bounded_batches, small, written
from tessera.llm.terms import AT_ONCE, WORDS, pieces, squeeze, values

#: Words in the strings that are candidates for a minimiser.
GRAM = 8
#: Windows in a super-k-mer at most, so that its string is bounded for texts of one repeated word.
MOST_WINDOWS = 256
#: Different strings in one part of a bucket, about, and words that are sorted together, about.
PART, SORTED_WORDS = 1 << 12, 1 << 20
#: Bytes of words that travel as they are; longer words travel as a digest, which is longer than this.
LONG_WORD = 63
NO_ID = (1 << 63) - 1
_STEPS = (np.uint64(0xD1342543DE82EF95), np.uint64(0x9E6C63D0676A9A99))


def super_kmers(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """minimiser, two prints, first, windows and owner of the super-k-mers of all values, in order.

    ``hashes`` are those of the words, ``at`` the len + 1 bounds of values in words.
    """
    gram = min(GRAM, window)
    starts, none = len(hashes) - window + 1, np.zeros(0, np.int64)
    if starts <= 0:
        return none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none, none
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for k in range(gram):
        grams = mix(grams * _STEPS[0] + hashes[k : len(hashes) - gram + 1 + k])
    span = window - gram + 1  # candidates in a window; minima from both ends of blocks of so many
    full = np.full(-(-len(grams) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    full[: len(grams)] = grams
    table = full.reshape(-1, span)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    minimiser = np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:starts]
    whole = np.arange(starts) + window <= at[1:][owner]
    new = np.ones(starts, bool)
    new[1:] = (minimiser[1:] != minimiser[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
    run = np.flatnonzero(new)
    since = np.arange(starts) - np.repeat(run, np.diff(np.append(run, starts)))
    first = np.flatnonzero(since % MOST_WINDOWS == 0)
    count = np.diff(np.append(first, starts))
    first, count = first[whole[first]], count[whole[first]]
    size = count + window - 1
    prints = [mix(size.astype(np.uint64) * s) for s in _STEPS]
    order = np.argsort(-size, kind="stable")  # long strings first: those still read are a prefix
    ends, sizes = np.array([p[order] for p in prints]), size[order]
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        word = hashes[first[order[:live]] + k]
        for p, s in zip(ends, _STEPS, strict=True):
            p[:live] = (p[:live] ^ word) * s
            p[:live] ^= p[:live] >> np.uint64(32)
    for p, e in zip(prints, ends, strict=True):
        p[order] = mix(e)
    return minimiser[first], prints[0], prints[1], first - at[:-1][owner[first]], count, owner[first]


def _finder(window: int) -> Callable:
    """Of every row its text's key, number of words, digest of the words, and super-k-mers."""

    def rows(ids, keys, counts, digests, found) -> pa.RecordBatch:
        minimiser, one, two, first, windows, owner = found
        offsets = pa.array(np.searchsorted(owner, np.arange(len(keys) + 1)).astype(np.int32))
        kinds = (minimiser.view(np.int64), one.view(np.int64), two.view(np.int64), first.astype(np.int32), windows.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in kinds]
        columns = [ids, pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns, ["doc", "text_key", "n_words", "whole", "minimiser", "print", "other_print", "first", "windows"])

    def of_long(data: np.ndarray) -> tuple:
        joined, hashes, first = hashlib.sha256(), [], True
        for piece in pieces(data, WORDS, AT_ONCE):
            out, starts, _ = squeeze(piece, np.array([0, len(piece)]), WORDS, False)
            if len(starts) > 1:
                joined.update(b"" if first else b" ")
                joined.update(out[:-1])
                hashes.append(word_hashes(out, starts[:-1], starts[1:] - 1))
                first = False
        hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        parts = []
        for lo in range(0, max(1, len(hashes)), AT_ONCE // 4):  # blocks that share window - 1 words
            body = hashes[lo : lo + AT_ONCE // 4 + window - 1]
            found = super_kmers(body, np.array([0, len(body)]), window)
            parts.append((*found[:3], found[3] + lo, *found[4:]))
        return len(hashes), joined.hexdigest(), tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column(1))
            for i, j in slices(bounds, AT_ONCE):
                body, ends = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                keys = [hashlib.md5(body[a:b]).digest() for a, b in pairwise(ends.tolist())]
                ids = batch.column(0).slice(i, j - i)
                if len(body) > 2 * AT_ONCE:
                    count, digest, found = of_long(body)
                    yield rows(ids, keys, [count], [digest], found)
                    continue
                out, starts, at = squeeze(body, ends, WORDS, False)
                digests = [hashlib.sha256(out[starts[a] : max(starts[b] - 1, starts[a])]).hexdigest() for a, b in pairwise(at.tolist())]
                yield rows(ids, keys, np.diff(at), digests, super_kmers(word_hashes(out, starts[:-1], starts[1:] - 1), at, window))

    return run


def _short(out: np.ndarray, starts: np.ndarray, lo: int, hi: int) -> bytes:
    """Words lo to hi, joined by spaces, the long ones as digests."""
    sizes = np.diff(starts[lo : hi + 1])
    if sizes.max() <= LONG_WORD + 1:
        return out[starts[lo] : starts[hi] - 1].tobytes()
    each = (out[starts[i] : starts[i + 1] - 1].tobytes() for i in range(lo, hi))
    return b" ".join(w if len(w) <= LONG_WORD else hashlib.sha256(w).hexdigest().encode() for w in each)


def _squeezed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of one text and their starts, made of pieces where it is long."""
    parts, at, size = [], [np.zeros(1, np.int64)], 0
    for piece in pieces(np.frombuffer(text, np.uint8), WORDS):
        out, starts, _ = squeeze(piece, np.array([0, len(piece)]), WORDS, False)
        parts.append(out)
        at.append(starts[1:] + size)
        size += len(out)
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate(at)


def _packer(window: int) -> Callable:
    """The packed strings of the super-k-mers wanted of each text."""
    names = ["minimiser", "part", "parts", "print", "other_print", "doc", "packed"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for text, wanted in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                out, starts = _squeezed(text.as_py())
                for w in wanted.as_py():
                    packed = _short(out, starts, w["first"], w["first"] + w["windows"] + window - 1)
                    rows.append((w["minimiser"], w["part"], w["parts"], w["print"], w["other_print"], w["doc"], packed))
                    size += len(packed)
                    if size > 1 << 22:
                        yield as_batch(rows)
                        rows, size = [], 0
        if rows:
            yield as_batch(rows)

    return run


def window_ranks(words: np.ndarray, window: int) -> np.ndarray:
    """For each place a number of the ``window`` words from there on; equal words, equal number.

    Ranks of 2k words come from sorting pairs of ranks of k words; no hash decides.
    """
    rank, size = words.astype(np.int64), 1
    while size < window:
        step = min(size, window - size)
        pair = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        size += step
    return rank


def _sorter(window: int) -> Callable:
    """Where each window of a string first stands: runs lo, hi, first_doc, or for parts of a bucket
    a digest of every window besides. Rows of one bucket come together."""
    names = ["minimiser", "print", "other_print", "lo", "hi", "first_doc", "key"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.binary())]]

    def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        joined = b" ".join([*(r["packed"] for r in rows), b""])
        body = np.frombuffer(joined, np.uint8)
        starts = np.concatenate(([0], np.flatnonzero(body == 0x20) + 1))
        number = values(body, starts).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        rank = window_ranks(number, window)
        at = np.searchsorted(starts, np.cumsum([0, *(len(r["packed"]) + 1 for r in rows)]))
        # windows of each string, without those that reach into the next one
        count = np.diff(at) - window + 1
        place = np.arange(count.sum()) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        docs = np.repeat(np.array([r["doc"] for r in rows], np.int64), count)
        least = np.full(int(rank.max(initial=0)) + 1, NO_ID)
        np.minimum.at(least, rank[place], docs)
        first = least[rank[place]]
        out, size, lo = [], 0, 0
        for r, a, n in zip(rows, at[:-1].tolist(), count.tolist(), strict=True):
            own = first[lo : lo + n]
            lo += n
            label = (r["minimiser"], r["print"], r["other_print"])
            if r["parts"] > 1:
                keys = [hashlib.blake2b(joined[starts[i] : starts[i + window]], digest_size=16).digest() for i in range(a, a + n)]
                out.append((*label, np.arange(n, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32), own, keys))
            else:
                cut = np.flatnonzero(np.diff(own, prepend=own[0] - 1 if own[0] else 1))
                out.append((*label, cut.astype(np.int32), np.append(cut[1:], n).astype(np.int32), own[cut], None))
            size += n if r["parts"] > 1 else 1
            if size > 1 << 15:
                yield as_batch(out)
                out, size = [], 0
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n_words, last = [], 0, None
        for batch in batches:
            for r in batch.to_pylist():
                bucket = (r["minimiser"], r["part"])
                if n_words >= SORTED_WORDS and bucket != last:
                    yield from settle(rows)
                    rows, n_words = [], 0
                rows.append(r)
                n_words += r["packed"].count(b" ") + 1
                last = bucket
        if rows:
            yield from settle(rows)

    return run


_LABEL = ["minimiser", "print", "other_print"]


def _first_documents(docs: DataFrame, text: str, distinct: DataFrame, window: int) -> DataFrame:
    """_LABEL, lo, hi, first_doc: for runs of windows of every different string where they first stand."""
    sizes = written(distinct.groupBy("minimiser").agg(F.count("*").alias("strings")).filter("strings > 1"), "kmer-buckets")
    parts = F.ceil(F.col("strings") / PART).cast("int")
    met = distinct.join(small(sizes), "minimiser", "left")
    alone = met.filter("strings is null").select(*_LABEL, F.lit(0).alias("lo"), F.col("at.windows").alias("hi"), F.col("doc").alias("first_doc"))
    shared = met.filter("strings is not null").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    wanted = F.struct("minimiser", "part", "parts", "print", "other_print", "doc", "at.first", "at.windows")
    wanted = written(shared.groupBy("at.text_key").agg(F.collect_list(wanted).alias("wanted")), "kmers-wanted")
    packed = _bodies(docs, text, wanted).select("text", "wanted").mapInArrow(_packer(window), "minimiser long, part int, parts int, print long, other_print long, doc long, packed binary")
    buckets = packed.repartition("minimiser", "part").sortWithinPartitions("minimiser", "part")
    schema = "minimiser long, print long, other_print long, lo array<int>, hi array<int>, first_doc array<long>, key array<binary>"
    sorted_ = written(buckets.mapInArrow(_sorter(window), schema), "kmers-sorted")
    runs = sorted_.filter("key is null").select(*_LABEL, F.inline(F.arrays_zip("lo", "hi", "first_doc")))
    split = sorted_.filter("key is not null").select(*_LABEL, F.inline(F.arrays_zip("lo", "hi", "first_doc", "key")))
    least = split.groupBy("key").agg(F.min("first_doc").alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", "least")
    merged = split.join(small(written(least, "kmer-windows")), "key", "left").select(*_LABEL, "lo", "hi", F.coalesce("least", "first_doc").alias("first_doc"))
    return alone.unionByName(runs).unionByName(merged)


def _bodies(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """The written table ``wanted`` (a row for each text_key) with the column ``text``."""
    bodies = docs.select(text_key(F.col(text)).alias("text_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return bodies.join(small(wanted.select("text_key")), "text_key", "left_semi").dropDuplicates(["text_key"]).join(wanted, "text_key")


def _cutter(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                out, starts = _squeezed(text.as_py())
                spans = np.array([(s["lo"], s["hi"]) for s in spans.as_py()], np.int64)
                change = np.zeros(len(starts), np.int64)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, np.minimum(spans[:, 1], len(starts) - 1), -1)
                gone = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
                kept = b"".join(out[starts[a] : starts[b]].tobytes() for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))[:-1]
                rows.append((key.as_py(), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["text_key", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_windows(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc, text_key, n_words, whole) of all documents, and (text_key, first_doc, spans).

    The second has one row for each different text: ``first_doc`` is the smallest doc_id with it
    and ``spans`` (null if none; struct lo, hi) the words of it to cut in that document. Spans may
    overlap. ``whole`` is the sha256 of the words joined by spaces.
    """
    bounded_batches(docs.sparkSession)
    lists = "minimiser array<long>, print array<long>, other_print array<long>, first array<int>, windows array<int>"
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = written(rows.mapInArrow(_finder(window), f"doc long, text_key binary, n_words long, whole string, {lists}"), "super-kmers")
    firsts = written(found.groupBy("text_key").agg(F.min("doc").alias("first_doc")), "kmer-texts")
    ranked = found.join(firsts.withColumnRenamed("first_doc", "doc"), ["text_key", "doc"], "left_semi").dropDuplicates(["text_key"])
    texts = written(ranked.filter("size(minimiser) > 0").drop("n_words", "whole"), "kmers-of-texts")
    many = texts.select(F.explode(F.array_distinct("minimiser")).alias("minimiser")).groupBy("minimiser").agg(F.count("*").alias("n")).filter("n > 1")
    many = written(many.select("minimiser"), "kmer-minimisers")
    single = texts.select("doc", "text_key", F.inline(F.arrays_zip("minimiser", "print", "other_print", "first", "windows")))
    candidates = written(single.join(small(many), "minimiser", "left_semi"), "kmer-candidates")
    at = F.min(F.struct("text_key", "first", "windows")).alias("at")
    distinct = written(candidates.groupBy(*_LABEL).agg(F.min("doc").alias("doc"), at), "kmers-distinct")
    first = written(_first_documents(docs, text, distinct, window), "kmer-first-documents")
    cut = candidates.join(first, _LABEL).filter(F.col("first_doc") < F.col("doc"))
    span = F.struct((F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi") + (window - 1)).alias("hi"))
    spans = cut.groupBy("text_key").agg(F.collect_set(span).alias("spans"))
    return found.select("doc", "text_key", "n_words", "whole"), firsts.join(written(spans, "kmer-spans"), "text_key", "left")


def cut_windows(docs: DataFrame, spans: DataFrame, window: int = 50, text: str = "text") -> DataFrame:
    """text_key, n_removed, kept_sha256, kept_text of each text with ``spans`` (a written table)."""
    bounded_batches(docs.sparkSession)
    read = _bodies(docs, text, spans).select("text_key", "text", "spans")
    return read.mapInArrow(_cutter(window), "text_key binary, n_removed long, kept_sha256 string, kept_text string")


def remove_windows(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed and kept_sha256 of every document.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of ``window`` words that
    covers it also starts in a document with a smaller key; windows are judged on the input. Rows
    with one key cut nothing from each other; a null key comes after all others. Null and empty
    texts have no words; a text with fewer words than a window keeps all. An empty table gives no
    rows. Other columns play no part.
    """
    rows, texts = repeated_windows(docs, window, key, text)
    texts = written(texts, "kmer-spans-of-texts")
    changed = cut_windows(docs, texts.filter("spans is not null").select("text_key", "spans"), window, text).drop("kept_text")
    # Written, so that Spark can split the rows of a frequent text in the join that follows.
    texts = written(texts.select("text_key", "first_doc").join(changed, "text_key", "left"), "kmer-texts-cut")
    out = rows.join(texts, "text_key")
    copy = (F.col("doc") > F.col("first_doc")) & (F.col("n_words") >= window)
    removed = F.when(copy, F.col("n_words")).when(F.col("doc") == F.col("first_doc"), F.col("n_removed"))
    digest = F.when(copy, F.sha2(F.lit(b""), 256)).when(F.col("doc") == F.col("first_doc"), F.col("kept_sha256"))
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias(key), "n_words", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"), F.coalesce(digest, "whole").alias("kept_sha256")
    )
