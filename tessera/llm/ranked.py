"""Exact ranked lexical search, score at a time over postings ordered by impact.

1. Items are read in blocks of about ``BLOCK_TERMS`` terms; one block's terms are the vocabulary of
   a pass over the documents. In tasks, terms of documents are looked up (by hash, then byte by
   byte) and shards of ``SHARD`` documents become forward indexes: ids, lengths, and for each
   document its vocabulary terms with their frequencies. They are written once; counts of
   documents, terms and documents a term has are sums over them.
2. A shard's postings are turned: for each term, documents in descending order of the posting's
   exact impact (weight times the integer part that depends on frequency and length), so that equal
   impacts form a group. For an item the groups of all its terms are processed in descending order,
   level by level, and added up in accumulators. What a term has not yet processed is at most its
   next group's impact. Once no document outside the candidates can reach the kth sum, the candidates'
   scores are completed from the forward index.
3. A task carries each item's kth score from shard to shard. Before that, one shard in
   ``SEED_EVERY`` is searched for a first kth score, so tasks start with a bound near the last one
   and pass on little more than k rows an item.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import LONG, eights, slices, text_buffers, word_hashes
from tessera.llm.scratch import bounded_batches, written
from tessera.llm.terms import ALPHANUMERICS, AT_ONCE, pieces, squeeze

#: Distinct terms of items in one block, about; documents in a shard; one shard in so many gives first bounds.
BLOCK_TERMS, SHARD, SEED_EVERY = 1 << 18, 1 << 13, 32
#: Postings after which a shard ends before it has SHARD documents.
SHARD_POSTINGS = 1 << 20


def terms_of(text: str | None) -> list[bytes]:
    """The distinct terms of one text, sorted."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    out, _, _ = squeeze(data, np.array([0, len(data)]), ALPHANUMERICS, True)
    return sorted(set(out.tobytes().split(b" ")[:-1]))


class Vocabulary:
    """Numbers of given terms, found by hash and confirmed byte by byte."""

    def __init__(self, terms: list[bytes]):
        starts = np.concatenate(([0], np.cumsum([len(t) for t in terms]))).astype(np.int64)
        body = np.frombuffer(b"".join(terms), np.uint8)
        hashes = word_hashes(body, starts[:-1], starts[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.body, self.starts = body, starts
        # Terms that share a hash (none is known) stand side by side; each of them is tried.
        self.most = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))

    def find(self, out: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each term of squeezed texts its number, or -1."""
        lo, hi = starts[:-1], starts[1:] - 1
        found = np.full(len(lo), -1)
        if not len(self.hashes) or not len(lo):
            return found
        hashes = word_hashes(out, lo, hi)
        spot = np.searchsorted(self.hashes, hashes)
        here, own = eights(out), eights(self.body)
        for more in range(self.most):
            at = np.minimum(spot + more, len(self.hashes) - 1)
            rows = np.flatnonzero((self.hashes[at] == hashes) & (found < 0))
            term = self.order[at[rows]]
            size = hi[rows] - lo[rows]
            same = size == self.starts[term + 1] - self.starts[term]
            for k in range(0, LONG, 8):
                live = np.flatnonzero(same & (size > k))
                if not len(live):
                    break
                mask = _FIRST[np.minimum(size[live] - k, 8)]
                same[live] = (here[lo[rows[live]] + k] & mask) == (own[self.starts[term[live]] + k] & mask)
            for i in np.flatnonzero(same & (size > LONG)).tolist():
                a, b = lo[rows[i]], self.starts[term[i]]
                same[i] = bool((out[a : a + size[i]] == self.body[b : b + size[i]]).all())
            found[rows[same]] = term[same]
        return found


#: Masks that keep the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
FORWARD = "shard long, n_docs long, n_terms long, ids binary, no_id binary, lengths binary, bounds binary, terms binary, counts binary, held array<struct<term: int, docs: long>>"


def _indexer(terms: list[bytes]) -> Callable:
    """Forward indexes of SHARD documents each, from (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        n_terms, shard = len(terms), TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        size = postings = 0

        def looked_up(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
            """Terms of each value, then value, term and count of its vocabulary terms."""
            out, starts, at = squeeze(body, ends, ALPHANUMERICS, True)
            term = vocabulary.find(out, starts)
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            key, count = np.unique(owner[term >= 0] * n_terms + term[term >= 0], return_counts=True)
            return np.diff(at), key // max(n_terms, 1), key % max(n_terms, 1), count

        def close() -> pa.RecordBatch:
            nonlocal docs, size, postings, shard
            ids = pa.concat_arrays([d[0] for d in docs])
            lengths = np.concatenate([d[1] for d in docs])
            per = np.concatenate([d[2] for d in docs])
            term, count = np.concatenate([d[3] for d in docs]), np.concatenate([d[4] for d in docs])
            held, n = np.unique(term, return_counts=True)
            values = [shard, int((lengths > 0).sum()), int(lengths.sum()), ids.fill_null(0).to_numpy().astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes()]
            values += [lengths.astype("<i8").tobytes(), np.concatenate(([0], np.cumsum(per))).astype("<i8").tobytes(), term.astype("<i4").tobytes(), count.astype("<i8").tobytes()]
            values.append([{"term": int(t), "docs": int(x)} for t, x in zip(held, n, strict=True)])
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.struct([("term", pa.int32()), ("docs", pa.int64())]))]
            docs, size, postings, shard = [], 0, 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split()[0] for f in FORWARD.split(", ")[:9]] + ["held"])

        for batch in batches:
            data, bounds = text_buffers(batch.column(1))
            for i, j in slices(bounds, AT_ONCE):
                body, ends = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                if len(body) > 2 * AT_ONCE:  # one long text: its pieces' counts are added up
                    parts = [looked_up(p, np.array([0, len(p)])) for p in pieces(body, ALPHANUMERICS, AT_ONCE)]
                    sums = np.zeros(n_terms, np.int64)
                    for p in parts:
                        sums[p[2]] += p[3]
                    length, owner, term, count = sum(p[0] for p in parts), np.zeros(int((sums > 0).sum()), np.int64), np.flatnonzero(sums), sums[sums > 0]
                else:
                    length, owner, term, count = looked_up(body, ends)
                docs.append((batch.column(0).slice(i, j - i).cast(pa.int64()), length, np.bincount(owner, minlength=j - i), term, count))
                size, postings = size + j - i, postings + len(term)
                if size >= SHARD or postings >= SHARD_POSTINGS:
                    yield close()
        if docs:
            yield close()

    return run


class Shard:
    """A shard's postings by term in descending order of impact, and its documents' impacts."""

    def __init__(self, row: dict, weights: np.ndarray, n_all: int, l_all: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.no_id = np.frombuffer(row["no_id"], np.uint8)
        self.bounds = np.frombuffer(row["bounds"], "<i8")
        self.terms = np.frombuffer(row["terms"], "<i4")
        count = np.frombuffer(row["counts"], "<i8")
        m = 100 - 90 + (90 * np.frombuffer(row["lengths"], "<i8") * n_all) // max(l_all, 1)
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        self.impacts = weights[self.terms] * ((1_000_000_000 * count) // (1000 * count + 8 * m[owner]))
        order = np.lexsort((-self.impacts, self.terms))
        self.docs, self.falling = owner[order], -self.impacts[order]  # ascending, for searchsorted
        self.lists = np.searchsorted(self.terms[order], np.arange(len(weights) + 1))

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, all that can be among the k best with ``least`` or more."""
        ends = self.lists[terms + 1]
        at = self.lists[terms].copy()
        terms, at, ends = terms[at < ends], at[at < ends], ends[at < ends]
        none = np.zeros(0, np.int64)
        if not len(terms):
            return none, none
        sums = np.zeros(len(self.ids), np.int64)
        ahead = -self.falling[at]  # what a document can still get from each term
        while True:
            rest = int(ahead.sum())
            bar = max(least, int(np.partition(sums, len(sums) - k)[-k]) if len(sums) > k else 0)
            if rest < bar or not rest:
                break
            # All groups of the next level: those down to the largest that remains, less an eighth.
            level = int(ahead.max()) * 7 // 8
            for i in np.flatnonzero(ahead > level).tolist():
                to = at[i] + int(np.searchsorted(self.falling[at[i] : ends[i]], -level, side="left"))
                sums[self.docs[at[i] : to]] -= self.falling[at[i] : to]
                at[i] = to
                ahead[i] = -self.falling[to] if to < ends[i] else 0
        # A document's sum lacks at most `rest`; those that can reach the bar get their whole score.
        able = np.flatnonzero((sums + rest >= max(bar, 1)) & (sums > 0))
        asked = np.zeros(len(self.lists) - 1, bool)
        asked[terms] = True
        sizes = np.diff(self.bounds)[able]
        spot = np.repeat(self.bounds[able] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(able)), sizes)
        scores = np.zeros(len(able), np.int64)
        np.add.at(scores, owner, np.where(asked[self.terms[spot]], self.impacts[spot], 0))
        good = (scores > 0) & (scores >= least)
        return able[good], scores[good]


def _searcher(items: list[list[int]], weights: list[int], n_all: int, l_all: int, k: int, least: list[int]) -> Callable:
    """item (its number), doc_id, score: the k best of every item in a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = [np.array(t, np.int64) for t in items], np.array(weights, np.int64)
        best: list[list[tuple]] = [[] for _ in items]  # (-score, no_id, id), ascending
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row, weight, n_all, l_all)
                for i, terms in enumerate(asked):
                    bar = max(least[i], -best[i][-1][0] if len(best[i]) == k else 0)
                    docs, scores = shard.search(terms, k, bar)
                    if len(docs):
                        pick = np.lexsort((shard.ids[docs], shard.no_id[docs], -scores))[:k]
                        fresh = zip((-scores[pick]).tolist(), shard.no_id[docs[pick]].tolist(), shard.ids[docs[pick]].tolist(), strict=True)
                        best[i] = sorted([*best[i], *fresh])[:k]
        rows = [(i, None if no else key, -score) for i, kept in enumerate(best) for score, no, key in kept]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


FOUND = "item int, doc_id long, score long"


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of a block's items, (item_id, text) rows."""
    spark = docs.sparkSession
    if not items:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    listed = [terms_of(r[1]) for r in items]
    vocabulary = sorted(set().union(*listed))
    number = {t: i for i, t in enumerate(vocabulary)}
    index = written(docs.mapInArrow(_indexer(vocabulary), FORWARD), "forward-index")
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l"), F.count("*").alias("shards")).first()
    held = {r.term: r.docs for r in index.select(F.inline("held")).groupBy("term").agg(F.sum("docs").alias("docs")).collect()}
    weights = [math.floor(1000 * math.log((2 * totals.n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))]
    asked = [[number[t] for t in terms] for terms in listed]
    search = lambda part, least: part.mapInArrow(_searcher(asked, weights, totals.n, totals.l, k, least), FOUND)
    is_seed = F.pmod(F.xxhash64("shard"), F.lit(SEED_EVERY)) == 0
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    seeds = written(best(search(index.filter(is_seed), [0] * len(items))), "first-scores")
    least = {r.item: r.score for r in seeds.filter(F.col("rank") == k).select("item", "score").collect()}
    rest = search(index.filter(~is_seed), [least.get(i, 0) for i in range(len(items))])
    names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(items)], "item int, item_id long")
    return best(seeds.drop("rank").unionByName(rest)).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 for every row of ``items``.

    Terms are maximal runs of letters, digits and all characters from U+0080 on, A-Z in lower case.
    The score is the one of the contract (saturated frequency against length, weighed by rarity), all
    in integers. Equal scores go to the smaller key, a null key last; rows that share a key are
    documents of their own, rows that share an item_id items of their own. Null and empty texts
    have no terms: such documents don't count, such items find nothing. Fewer matches give fewer
    rows, empty tables none. Other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = items.select(F.col(item).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # A term takes two bytes with what parts it from the next, so bytes bound a block's terms.
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("bytes")).first().bytes
    blocks = max(1, -(-total // (2 * BLOCK_TERMS)))
    parts = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        parts.append(_search_block(docs, rows, k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
