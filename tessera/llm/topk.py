"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors become integers, ``floor(scale * x)``. A block is a range of documents with a
forward index (its vectors, packed) and, for each term (dimension), the largest and the
smallest value. For a query, the sum over terms of what the best value could give bounds
every score in the block. In a task each query visits the blocks in the order of its own
bounds and stops as soon as they cannot beat its kth score; every query's best k of each task
then meet.

Blocks are dealt to lanes and each batch of queries visits every lane, so work splits by
queries and by documents and no side is broadcast. Rows passed on are k a query and lane.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import written

#: Vectors in a block and queries in a batch.
BLOCK, QUERIES = 512, 2048
#: Blocks in a lane, about.
LANE_BLOCKS = 8
NO_ID = -(1 << 63)


def _packer(per: int) -> Callable:
    """Rows (id, values) of a partition as blocks: part, block, dims, ids, values, highs, lows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def close() -> pa.RecordBatch:
            nonlocal block, ids, rows
            dims = max(len(r) for r in rows)
            table = np.zeros((len(rows), dims), "<i8")
            for i, r in enumerate(rows):
                table[i, : len(r)] = r
            values = [part, block, dims, np.array(ids, "<i8").tobytes(), table.tobytes(), table.max(axis=0).tobytes(), table.min(axis=0).tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            block, ids, rows = block + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["part", "block", "dims", "ids", "table", "highs", "lows"])

        for batch in batches:
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if key is None else key)
                rows.append(row)
                if len(rows) == per:
                    yield close()
        if rows:
            yield close()

    return run


PACKED = "part int, block int, dims int, ids binary, table binary, highs binary, lows binary"


def product(a: np.ndarray, b: np.ndarray, bound: bool = False) -> np.ndarray:
    """Exact integer a @ b.T: in floating point where every sum is below 2**53, else in integers.

    A sum beyond 63 bits is an error; a ``bound`` that is too large becomes the largest number.
    """
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * n
    if top < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    if not n or not whole.size:
        return np.zeros(whole.shape, np.int64)
    if bound:
        return np.clip(whole, LOWEST, np.iinfo(np.int64).max).astype(np.int64)
    if max(whole.max(), -whole.min()) >= 1 << 63:
        raise OverflowError("a score has more than 63 bits")
    return whole.astype(np.int64)


def bounds(queries: np.ndarray, highs: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each query and block (rows of highs and lows) a sum no score in the block exceeds."""
    above, below = np.maximum(queries, 0), np.minimum(queries, 0)
    n = min(queries.shape[1], highs.shape[1])
    return product(np.concatenate((above[:, :n], below[:, :n]), axis=1), np.concatenate((highs[:, :n], lows[:, :n]), axis=1), bound=True)


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row the columns of its k best: the highest scores, then the smallest ids."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        return np.stack([_first(s, i, e, k) for s, i, e in zip(scores, ids, edge, strict=True)])
    return np.stack([np.lexsort((i, -s)) for s, i in zip(scores, ids, strict=True)])


def _first(scores: np.ndarray, ids: np.ndarray, edge: int, k: int) -> np.ndarray:
    near = np.flatnonzero(scores >= edge)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


LOWEST = np.iinfo(np.int64).min + 1  # its negative is a number too


def _searcher(k: int) -> Callable:
    """Rows of one lane: its blocks, then batches of queries (kind 0 and 1), all of one lane together."""

    def search(rows: list[dict], queries: dict) -> pa.RecordBatch:
        own = np.frombuffer(queries["ids"], "<i8")
        q = np.frombuffer(queries["table"], "<i8").reshape(len(own), queries["dims"])
        tag = (queries["part"], queries["block"])
        best = np.full((len(q), k), LOWEST)
        names = np.full((len(q), k), np.iinfo(np.int64).max)
        dims = max(r["dims"] for r in rows)
        edges = np.zeros((2, len(rows), dims), np.int64)
        for i, r in enumerate(rows):
            edges[0, i, : r["dims"]] = np.frombuffer(r["highs"], "<i8")
            edges[1, i, : r["dims"]] = np.frombuffer(r["lows"], "<i8")
        limit = bounds(q, edges[0], edges[1])
        # Each query visits the blocks in the order of its own bounds; those that come to one
        # block at the same turn are scored together.
        order = np.argsort(-limit, axis=1, kind="stable")
        for turn in range(len(rows)):
            chosen = order[:, turn]
            # a block whose bound equals the kth score may still hold a smaller id
            going = limit[np.arange(len(q)), chosen] >= best[:, -1]
            if not going.any():
                break  # bounds only fall from here on
            for i in np.unique(chosen[going]):
                r, open_ = rows[i], np.flatnonzero(going & (chosen == i))
                ids = np.frombuffer(r["ids"], "<i8")
                scores = product(q[open_], np.frombuffer(r["table"], "<i8").reshape(len(ids), r["dims"]))
                if (r["part"], r["block"]) == tag:  # a query's own row is no candidate of its own
                    scores[np.arange(len(open_)), open_] = LOWEST
                worth = np.flatnonzero(scores.max(axis=1) >= best[open_, -1])
                if not len(worth):
                    continue
                scores, rank = scores[worth], open_[worth]
                known = np.where(ids == NO_ID, np.iinfo(np.int64).max, ids)
                all_scores = np.concatenate((best[rank], scores), axis=1)
                all_ids = np.concatenate((names[rank], np.broadcast_to(known, scores.shape)), axis=1)
                pick = _better(all_scores, all_ids, k)
                best[rank] = np.take_along_axis(all_scores, pick, axis=1)
                names[rank] = np.take_along_axis(all_ids, pick, axis=1)
        at, place = np.nonzero(best > LOWEST)
        found = names[at, place]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), tag[0], np.int32)),
                pa.array(np.full(len(at), tag[1], np.int32)),
                pa.array(at.astype(np.int32)),
                pa.array(own[at]),
                pa.array(found, mask=found == np.iinfo(np.int64).max),
                pa.array(best[at, place]),
            ],
            ["part", "block", "place", "query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] != lane:
                    lane, rows = row["lane"], []
                if row["kind"] == 0:
                    rows.append(row)
                elif rows:
                    yield search(rows, row)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose key is divisible by ``every``.

    Scores are inner products of ``floor(scale * x)``; equal scores go to the smaller id, a null
    id last. A shorter vector counts as padded with zeros. Vectors that are null or hold a null
    or non-finite component take no part. Rows that share an id are rows of their own: a query
    leaves out only itself. With fewer than k other rows there are fewer results; with an empty
    table none. An empty vector scores 0. Components or scores beyond 63 bits are an error.
    """
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col(vector).isNotNull()).filter(finite)
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    fits = lambda x: F.when(F.abs(scaled(x)) < float(1 << 63), F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a component has more than 63 bits")).cast("long"))
    whole = F.transform(F.col(vector), fits)
    rows = usable.select(F.col(key).cast("long").alias("id"), whole.alias("values"))
    is_query = F.coalesce(F.pmod(F.col("id"), F.lit(every)) == 0, F.lit(False))
    # Queries fill blocks of their own, so a batch of queries is a block and knows its own rows.
    # They have negative numbers, apart from the others'.
    asked = rows.filter(is_query).mapInArrow(_packer(QUERIES), PACKED)
    asked = written(asked.withColumn("block", -1 - F.col("block")), "query-blocks")
    rest = written(rows.filter(~is_query).mapInArrow(_packer(BLOCK), PACKED), "vector-blocks")
    lanes = max(1, (rest.count() + asked.count()) // LANE_BLOCKS)
    lane = F.pmod(F.xxhash64("part", "block"), F.lit(lanes)).cast("int")
    blocks = rest.unionByName(asked).withColumn("lane", lane).withColumn("kind", F.lit(0))
    visits = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).withColumn("kind", F.lit(1))
    met = blocks.unionByName(visits).repartition("lane").sortWithinPartitions("lane", "kind")
    found = met.mapInArrow(_searcher(k), "part int, block int, place int, query_id long, vec_id long, score long")
    best = Window.partitionBy("part", "block", "place").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
