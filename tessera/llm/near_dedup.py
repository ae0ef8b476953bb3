"""MinHash near-duplicate detection by fast similarity sketching, banding and exact checks.

Sketch: in round i every shingle is thrown at one of t places with a value that starts
with i; a place keeps its smallest value. Rounds t .. 2t-1 throw every shingle at place
i - t, so all places fill after 2t rounds and most sets need a handful. Two sets agree in
a place with a probability of their Jaccard similarity, concentrated as for independent
hash functions.

Banding: ``bands`` groups of ``rows`` places are hashed; sets that share a band are
candidates, and all candidates count. With 7 rows and 52 bands a pair at similarity 0.8 is
missed with a probability of 5e-6, at 0.85 of 2e-9.

Exact check: candidates are compared on their full shingle sets, read from the texts again.

Large groups: only components matter, so not all pairs of a band are compared. Texts with
one shingle set are one node. In a band, the node that meets most others in all its bands -
the text that a group's copies were made from, say - is compared with the rest; those found
linked join its component, and so do those that several leaders link in turn. What is left -
pairs in different components that no comparison has settled - is small for groups of copies;
while it isn't, those texts are grouped by their rarest shingles instead of bands (a prefix
filter, which loses no pair), more leaders are taken from each group, several times as many
in every round, and at last all pairs left are weighed: those of other labels than a group's
most frequent one with all others. Every pair that shares a band thus ends up compared, or in one component, or is known to share too few shingles. Copies too
far from all others, however many, are set apart by their rare shingles and not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.hashing import mix, shingle_sets, slices, text_buffers
from tessera.llm.repeats import text_key
from tessera.llm.scratch import bounded_batches, small, written

#: Pairs left for each row left in a band, up to which all are compared at once.
PAIRS_PER_ROW = 0.5
#: The same once groups are those of rare shingles, where few of the pairs weighed are compared.
WEIGHED_PER_ROW = 1000
#: Times as many leaders in each round.
MORE_LEADERS = 4


def sketch(hashes: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """One row of ``places`` values for each set; sets must not be empty."""
    n = len(bounds) - 1
    out = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for i in range(2 * places):
        h = mix(hashes ^ mix(np.full(1, i + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        if i < places:
            place = ((h >> np.uint64(40)) * np.uint64(places)) >> np.uint64(24)
        else:
            place = np.full(len(h), i - places, np.uint64)
        np.minimum.at(out, owner * places + place.astype(np.int64), np.uint64(i << 44) | (h & np.uint64((1 << 44) - 1)))
        open_ = (out.reshape(n, places) == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        going = open_[owner]
        if not going.all():
            hashes, owner = hashes[going], owner[going]
    return out.reshape(n, places)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grouped = sketches.reshape(len(sketches), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sketches), bands)).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + grouped[:, :, k])
    return out.view(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for a set; None for an empty one."""
    one, two = mix(hashes), mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (one, two)]
    both = np.stack([mix(s[bounds[1:]] - s[bounds[:-1]]) for s in sums], axis=1).astype(">u8")
    raw = both.tobytes()
    return [raw[16 * i : 16 * i + 16] if bounds[i + 1] > bounds[i] else None for i in range(len(bounds) - 1)]


def _sketcher(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, bounds = text_buffers(batch.column(1))
            for i, j in slices(bounds, 1 << 18):
                hashes, at = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size)
                counts = np.diff(at)
                full = np.flatnonzero(counts)
                keys = np.zeros((0, bands), np.int64)
                if len(full):
                    keys = band_keys(sketch(hashes, np.concatenate(([0], np.cumsum(counts[full]))), bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts > 0) * bands)).astype(np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.arange(row, row + j - i)), pa.array(counts), pa.array(signatures(hashes, at), pa.binary()), lists],
                    ["doc_id", "text_key", "row", "n_shingles", "mark", "bands"],
                )
                row += j - i

    return run


def _set_maker(size: int) -> Callable:
    """The shingle hashes of the texts that have the mark asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_buffers(batch.column(2))
            nodes, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(bounds, 1 << 18):
                hashes, at = shingle_sets(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], size)
                found = [k for k, mark in enumerate(signatures(hashes, at)) if mark == marks[i + k]]
                sets = [hashes[at[k] : at[k + 1]].tobytes() for k in found]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i + k] for k in found], pa.int64()), pa.array(sets, pa.binary())], ["node", "hashes"])

    return run


def _comparer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        shared = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared.append(int(np.count_nonzero(both[1:] == both[:-1])))
        sizes = [pa.array([len(x.as_buffer()) // 8 for x in c], pa.int64()) for c in (a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(shared, pa.int64())], ["a", "b", "n_a", "n_b", "shared"])


def _set_lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        lists = pa.ListArray.from_arrays(pa.array((bounds // 8).astype(np.int32)), pa.array(data.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "hashes"])


def _rarest(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """band, node, n, k, weight, label: the nodes of ``left`` by their rarest shingles.

    A node's shingles are ordered by how many nodes of ``left`` have them. If the first
    shingle that two nodes share stands at place ``n - k`` of each one's order, they share
    no more than the smaller k; rows whose k is too small for any partner leave.
    """
    nodes = left.groupBy("node").agg(F.first("n").alias("n"), F.first("weight").alias("weight"), F.first("label").alias("label"))
    nodes = written(nodes, "nodes-left")
    own = sets.join(small(nodes.select("node")), "node").mapInArrow(_set_lister, "node long, hashes array<long>")
    shingles = written(own, "shingles-left").select("node", F.explode("hashes").alias("band"))
    several = shingles.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    order = Window.partitionBy("node")
    met = shingles.join(several, "band").withColumn("m", F.count("*").over(order)).withColumn("place", F.row_number().over(order.orderBy("c", "band")))
    # shingles of one node only come first; of the m others, those up to this one are behind it
    met = met.select("band", "node", (F.col("m") - F.col("place") + 1).cast("int").alias("k")).join(nodes, "node")
    return met.filter(100 * F.col("k") >= percent * F.col("n")).select("band", "node", "n", "k", "weight", "label")


@dataclass
class NearDuplicates:
    """documents: doc_id, n_shingles, component_id, kept. links: compared pairs of nodes that are linked.

    survivors: doc_id, text_key (md5 of the text) of one document of each component with words.
    """

    documents: DataFrame
    links: DataFrame
    survivors: DataFrame


def _side_by_side(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """a, b and ``column`` of both as a_side and b_side; only what belongs to the pairs is dealt out."""
    pairs = small(pairs)
    of_b = values.select(F.col("node").alias("b"), F.col(column).alias("b_side")).join(pairs, "b")
    heads = values.join(pairs.select(F.col("a").alias("node")).distinct(), "node").select(F.col("node").alias("a"), F.col(column).alias("a_side"))
    return of_b.join(heads, "a").select("a", "b", "a_side", "b_side")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough: a, b, n_a, n_b, shared."""
    met = _side_by_side(pairs, sets, "hashes").mapInArrow(_comparer, "a long, b long, n_a long, n_b long, shared long")
    return met.filter(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))


def _mixed(left: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one label."""
    several = left.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("band")
    return left.join(several, "band", "left_semi")


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = 52, rows: int = 7, key: str = "doc_id", text: str = "text"
) -> NearDuplicates:
    """Components of documents linked by ``100 * |A & B| >= percent * |A | B|``.

    A-Z is lowered; words are runs of other than ASCII white space; a document's set holds
    its distinct ``shingle_words``-word shingles, or all its words as one if it has fewer.
    Without words (null, empty, blank) the set is empty: no links, its own component.
    ``component_id`` is the smallest key reachable, itself included; ``kept`` marks it. Null
    keys never name a component that has another key; repeated rows share all results; an
    empty table gives no rows. Other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    rows_in = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = rows_in.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    schema = "doc_id long, text_key binary, row long, n_shingles long, mark binary, bands array<long>"
    sketched = written(keyed.mapInArrow(_sketcher(shingle_words, bands, rows), schema), "sketches")
    # The smallest key, null last; of texts that share it, the smallest text_key.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    nodes = sketched.filter("mark is not null").groupBy("mark").agg(
        F.min("row").alias("node"), first.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    nodes = written(nodes, "nodes")
    banded = nodes.select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    members = written(banded.join(shared, "band").select("band", "node", "n"), "band-members")

    wanted = written(nodes.join(members.select("node").distinct(), "node").select("node", "mark", "first"), "banded-nodes")
    named = small(wanted.select("node", "mark", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")))
    # By both: a key, or null, may stand at any number of texts.
    source = keyed.join(named, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))).select("node", "mark", "text")
    sets = written(source.mapInArrow(_set_maker(shingle_words), "node long, hashes binary").dropDuplicates(["node"]), "shingle-sets")

    # How many rows a node meets in its bands: most for the centre of a group of copies.
    sizes = members.groupBy("band").agg(F.count("*").alias("met"))
    weights = members.join(sizes, "band").groupBy("node").agg(F.sum("met").alias("weight"))
    left = members.join(weights, "node").select("*", F.col("n").alias("k"), F.col("node").alias("label"))
    links, leaders = None, 1
    while True:
        by_label = left.groupBy("band", "label").agg(F.count("*").alias("m"), F.max(F.struct("weight", "node")).alias("top"))
        bands_left = by_label.groupBy("band").agg(F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count("*").alias("labels"), F.max("top").alias("top"), F.max(F.struct("m", "label")).alias("most"))
        bands_left = written(bands_left.filter("labels > 1"), "bands-left")
        size, pairs = bands_left.agg(F.sum("size"), F.sum((F.col("size") * F.col("size") - F.col("same")) / 2)).first()
        if not size:
            break
        last = pairs <= (PAIRS_PER_ROW if leaders == 1 else WEIGHED_PER_ROW) * size
        is_leader = (F.col("node") == F.col("top.node")) | (F.pmod(F.xxhash64("node", F.lit(leaders)), "size") < leaders - 1)
        left = left.join(bands_left, "band").withColumn("is_leader", F.col("label") != F.col("most.label") if last else is_leader)
        left = written(left.select("band", "node", "n", "k", "weight", "label", "is_leader"), "band-rows")
        heads = left.filter("is_leader").select("band", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("k").alias("k_a"), F.col("label").alias("label_a"))
        rest = left.select("band", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), F.col("label").alias("label_b"), F.col("is_leader").alias("leader_b"))
        met = heads.join(rest, "band").filter("label_a != label_b and (not leader_b or a < b)")
        met = met.filter((100 + percent) * F.least("k_a", "k_b") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
        found = written(_linked(written(met, "pairs"), sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        if last:
            break
        # What this round has linked is one component from now on, whichever leaders linked it.
        known = left.select(F.col("node").alias("a"), F.col("label").alias("b")).distinct()
        joined = connected_components(found.select("a", "b").unionByName(known)).withColumnRenamed("label", "joined")
        left = left.filter("not is_leader").join(joined, "node").select("band", "node", "n", "k", "weight", F.col("joined").alias("label"))
        if leaders == 1:
            left = _rarest(_mixed(left), sets, percent)
        leaders *= MORE_LEADERS
    if links is None:
        links = written(_linked(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), sets, percent), "links")
    labels = connected_components(links)

    placed = sketched.select("doc_id", "text_key", "n_shingles", "mark").join(nodes.select("mark", "node"), "mark", "left").join(labels, "node", "left")
    placed = placed.withColumn("group", F.coalesce("label", "node"))
    firsts = placed.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(firsts, "group", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    documents = out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    survivors = placed.filter("group is not null").groupBy("group").agg(first.alias("at")).select("at.doc_id", "at.text_key")
    return NearDuplicates(documents, links, survivors)
