"""Source divergence audit: how each source's words differ from its language's and its other sources'.

Counts. Tasks count terms by language and source in blocks of documents, so what is shuffled are
sums; terms of a language meet once, those in fewer than ``least_docs`` documents leave, and the
kept counts are written as postings (language, term, total in the language, source, count).

Terms. A group's terms with one count have one probability p, so they are a bucket, and the smallest
language probability q in the bucket bounds its values f = (p - q)^2 div q; the bound is reached by
a term of the bucket. The kth bound of a group is therefore a first lower bound of its kth value, and
buckets strictly below it stay unread. Tasks then evaluate their part of a group's postings best
bucket first and stop once the bounds of all unseen ones are strictly below their kth value.

Pairs. For two sources of a language the sum over all kept terms is split by inclusion: a term that
neither has gives a constant, a term that one has depends on its count alone (a sum over buckets),
and only terms that both have are read from postings, where tasks add up corrections by pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.hashing import slices, text_buffers
from tessera.llm.scratch import BROADCAST_BYTES, bounded_batches, written
from tessera.llm.terms import AT_ONCE, LETTERS, pieces, squeeze, values

#: Probabilities are integers of this scale.
SCALE = 1_000_000_000
#: (document, term) counts that a task adds up at once; postings, and pairs of them, likewise.
COUNTS, POSTINGS, PAIRS = 1 << 21, 1 << 18, 1 << 20


class _Numbers:
    """Numbers of strings in order of appearance."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        table = np.array([self.known.setdefault(v, len(self.known)) for v in coded.dictionary.to_pylist()], np.int64)
        return table[coded.indices.to_numpy(zero_copy_only=False)]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, term, docs, posts (source, n) of blocks of documents, from lang, source, text."""
    langs, sources = _Numbers(), _Numbers()
    held: list[tuple] = []  # lang, source, count and dictionary-encoded term of (document, term) pairs
    size = 0

    def counted(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """value, count and term of the pairs of some texts."""
        out, starts, at = squeeze(body, ends, LETTERS, True)
        coded = values(out, starts).dictionary_encode()
        n_terms = max(1, len(coded.dictionary))
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key, n = np.unique(owner * n_terms + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        return key // n_terms, n, pa.DictionaryArray.from_arrays(pa.array((key % n_terms).astype(np.int32)), coded.dictionary)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, langs, sources
        terms = pa.chunked_array([h[3] for h in held]).unify_dictionaries()
        code = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in terms.chunks]).astype(np.int64)
        names = pc.utf8_rtrim(terms.chunk(0).dictionary.cast(pa.large_string()), " ")
        lang, source, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        n_terms, n_sources = len(names), len(sources.known)
        key, place, docs = np.unique((lang * n_terms + code) * n_sources + source, return_inverse=True, return_counts=True)
        n = np.bincount(place, n).astype(np.int64)
        first = np.flatnonzero(np.diff(key // n_sources, prepend=-1))
        offsets = np.append(first, len(key))
        docs = np.add.reduceat(docs, first)
        lang_names, source_names = pa.array(list(langs.known), pa.string()), pa.array(list(sources.known), pa.string())
        for a in range(0, len(first), 1 << 16):
            b = min(a + (1 << 16), len(first))
            own = key[offsets[a] : offsets[b]]
            posts = pa.StructArray.from_arrays([source_names.take(pa.array(own % n_sources)), pa.array(n[offsets[a] : offsets[b]])], ["source", "n"])
            head = key[first[a:b]] // n_sources
            columns = [lang_names.take(pa.array(head // n_terms)), names.take(pa.array(head % n_terms)).cast(pa.string()), pa.array(docs[a:b])]
            posts = pa.ListArray.from_arrays(pa.array((offsets[a : b + 1] - offsets[a]).astype(np.int32)), posts)
            yield pa.RecordBatch.from_arrays([*columns, posts], ["lang", "term", "docs", "posts"])
        held, size, langs, sources = [], 0, _Numbers(), _Numbers()

    for batch in batches:
        data, bounds = text_buffers(batch.column(2))
        for i, j in slices(bounds, 4 * AT_ONCE):
            body, ends = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            if len(body) > 8 * AT_ONCE:  # one long text: counts of its pieces become one
                parts = [counted(p, np.array([0, len(p)]))[1:] for p in pieces(body, LETTERS, AT_ONCE)]
                table = pa.table({"term": pa.chunked_array([p[1].cast(pa.large_binary()) for p in parts], pa.large_binary()), "n": pa.chunked_array([pa.array(p[0]) for p in parts])})
                table = table.group_by("term").aggregate([("n", "sum")]).combine_chunks()
                n, term = table["n_sum"].to_numpy(), table["term"].combine_chunks().dictionary_encode()
                owner = np.zeros(len(n), np.int64)
            else:
                owner, n, term = counted(body, ends)
            if len(n):
                lang, source = (numbers.of(batch.column(c).slice(i, j - i)) for numbers, c in ((langs, 0), (sources, 1)))
                held.append((lang[owner], source[owner], n, term))
                size += len(n)
            if size >= COUNTS:
                yield from flush()
    if held:
        yield from flush()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _divergence(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div {q}"


def _probability(count: str, total: str) -> Column:
    """SQL of 1 + SCALE * (count + 1) div (total + kept), columns named."""
    return F.expr(f"1 + ({SCALE} * ({count} + 1)) div ({total} + kept)")


def _bounded(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its strings and 16 bytes a column have BROADCAST_BYTES at most."""
    text = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    row = sum(text, F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(row).alias("b")).first().b or 0) <= BROADCAST_BYTES else df


def _term_searcher(k: int) -> Callable:
    """The k best terms of every group among a task's postings: lang, source, item, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}  # (-value, term), ascending
        held, size = [], 0

        def settle() -> None:
            nonlocal held, size
            rows = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            n, p, q = (rows[c].to_numpy() for c in ("n", "p", "q"))
            order = np.lexsort((n, group))
            group, n, p, q = group[order], n[order], p[order], q[order]
            new = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(n, prepend=-1) != 0))  # buckets
            ends = np.append(new[1:], len(n))
            bound = divergence(p[new], np.minimum.reduceat(q, new))
            edges = np.flatnonzero(np.diff(group[new], prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(new)], strict=True):
                g = int(group[new[a]])
                name = (lang.dictionary[g // len(source.dictionary)].as_py(), source.dictionary[g % len(source.dictionary)].as_py())
                kept = best.setdefault(name, [])
                for bucket in (a + np.argsort(-bound[a:b], kind="stable")).tolist():
                    kth = -kept[-1][0] if len(kept) == k else -1
                    if bound[bucket] < kth:
                        break
                    lo, hi = new[bucket], ends[bucket]
                    value = divergence(p[lo:hi], q[lo:hi])
                    good = np.flatnonzero(value >= kth)
                    if len(good) > k:  # all that tie with the kth of the bucket stay
                        good = good[value[good] >= np.partition(value[good], len(good) - k)[-k]]
                    terms = rows["term"].take(pa.array(order[lo + good])).to_pylist()
                    kept = best[name] = sorted([*kept, *zip((-value[good]).tolist(), (t.encode() for t in terms), strict=True)])[:k]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= POSTINGS:
                settle()
        if size:
            settle()
        for (lang, source), kept in best.items():
            columns = ([lang] * len(kept), [source] * len(kept), [t.decode() for _, t in kept], [-v for v, _ in kept])
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["lang", "source", "item", "value"])

    return run


def _pairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms of both sources add to a pair, besides each one's own part; rows of one term come together."""
    groups: dict[tuple[str, str], int] = {}
    key, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held, size, last = [], 0, None

    def add(more_key: np.ndarray, more: np.ndarray) -> None:
        nonlocal key, total
        key, place = np.unique(np.concatenate((key, more_key)), return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, place, np.concatenate((total, more)))
        total = sums

    def settle(rows: pa.Table) -> None:
        lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        seen, place = np.unique(pair, return_inverse=True)
        names = [(lang.dictionary[g // len(source.dictionary)].as_py(), source.dictionary[g % len(source.dictionary)].as_py()) for g in seen.tolist()]
        number = np.array([groups.setdefault(x, len(groups)) for x in names], np.int64)[place]
        term, p, p0 = (rows[c].to_numpy() for c in ("term_row", "p", "p0"))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        many = np.diff(np.append(first, len(term)))
        start, partners = np.repeat(first, many), np.repeat(many, many)
        upto = np.cumsum(partners)
        lo = 0
        while lo < len(term):  # rows with about PAIRS partners in all
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(lo, hi), partners[lo:hi])
            j = np.arange(len(i)) - np.repeat(np.cumsum(partners[lo:hi]) - partners[lo:hi], partners[lo:hi]) + start[i]
            other = i != j
            i, j = i[other], j[other]
            joint = divergence(p[i], p[j]) - divergence(p[i], p0[j]) - divergence(p0[i], p[j]) + divergence(p0[i], p0[j])
            add(number[i] << 32 | number[j], joint)
            lo = hi

    def flush() -> pa.RecordBatch:
        nonlocal key, total
        names = list(groups)
        a, b = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
        columns = ([names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b], total)
        key, out, total = key[:0], columns, total[:0]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < POSTINGS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        term = rows["term_row"].to_numpy()
        last = int(np.searchsorted(term, term[-1]))  # the last term may go on
        if last:
            settle(rows.slice(0, last))
            held, size = rows.slice(last).to_batches(), len(rows) - last
        if len(key) > PAIRS:
            yield flush()
    if size:
        settle(pa.Table.from_batches(held).combine_chunks())
    if len(key):
        yield flush()


def audit(docs: DataFrame, k: int = 200, least_docs: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every group (lang, source).

    Part ``pair``: every other source of the language and the sum of f over all kept terms. Part
    ``term``: the k terms with a count in the group and p > q by f. Equal values are ranked by item in
    the order of UTF-8. Nulls count as ''. Groups without terms have pairs, no terms; a language
    without kept terms has value 0 for all pairs, one with one source none. Repeated rows count each
    time; an empty table gives no rows. Other columns play no part.
    """
    bounded_batches(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    groups = docs.select("lang", "source").distinct()

    found = docs.mapInArrow(_counter, "lang string, term string, docs long, posts array<struct<source: string, n: long>>")
    # Dealt by language and term first: all sums below then stay where they are.
    met = found.repartition("lang", "term").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.flatten(F.collect_list("posts")).alias("posts"))
    kept = met.filter(F.col("docs") >= least_docs).select("lang", "term", F.monotonically_increasing_id().alias("term_row"), F.expr("aggregate(posts, 0L, (s, x) -> s + x.n)").alias("total"), "posts")
    postings = kept.select("lang", "term", "term_row", "total", F.inline("posts")).groupBy("lang", "term", "term_row", "total", "source").agg(F.sum("n").alias("n"))
    postings = written(postings, "postings")

    langs = postings.select("lang", "term_row", "total").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    zero = F.lit(0).cast("long")
    sizes = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = sizes.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("group_n", "kept", "lang_n")))
    sizes = written(sizes.withColumn("p0", F.when(F.col("kept") > 0, _probability("0", "group_n"))), "group-sizes")
    known = _bounded(sizes)
    shaped = postings.join(known, ["lang", "source"]).withColumn("p", _probability("n", "group_n")).withColumn("q", _probability("total", "lang_n"))
    buckets = shaped.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("terms"), F.min("q").alias("least_q"))
    buckets = written(buckets.withColumn("bound", F.when(F.col("p") > F.col("least_q"), F.expr(_divergence("p", "least_q")))), "buckets")

    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("bound"))
    kth = buckets.filter("bound is not null").withColumn("place", F.row_number().over(ordered)).filter(F.col("place") <= k)
    kth = kth.groupBy("lang", "source").agg(F.max(F.struct("place", "bound")).alias("last")).select("lang", "source", F.when(F.col("last.place") == k, F.col("last.bound")).otherwise(zero).alias("least"))
    kth = _bounded(written(kth, "first-bounds"))
    open_ = buckets.filter("bound is not null").join(kth, ["lang", "source"]).filter("bound >= least").select("lang", "source", "n")
    asked = shaped.filter("p > q").join(_bounded(written(open_, "open-buckets")), ["lang", "source", "n"])
    found_terms = asked.select("lang", "source", "term", "n", "p", "q").mapInArrow(_term_searcher(k), "lang string, source string, item string, value long")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found_terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= k)

    both = shaped.select("lang", "source", "term_row", "p", "p0").repartition("term_row").sortWithinPartitions("term_row")
    joint = both.mapInArrow(_pairer, "lang string, source string, item string, value long")
    other = sizes.select("lang", F.col("source").alias("item"), F.col("p0").alias("other_p0"), "kept")
    beside = lambda rows: rows.join(_bounded(other), "lang").filter("source != item")
    none = beside(sizes.select("lang", "source", "p0")).select("lang", "source", "item", F.when(F.col("kept") > 0, F.expr(f"kept * ({_divergence('p0', 'other_p0')})")).otherwise(zero).alias("value"))
    one = f"terms * ({_divergence('p', 'other_p0')} - {_divergence('p0', 'other_p0')})"
    back = f"terms * ({_divergence('other_p0', 'p')} - {_divergence('other_p0', 'p0')})"
    each = beside(buckets.select("lang", "source", "p", "p0", "terms"))
    each = each.groupBy("lang", "source", "item").agg(F.sum(F.expr(one)).alias("there"), F.sum(F.expr(back)).alias("back"))
    each = each.select("lang", F.inline(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))))
    pairs = none.unionByName(each).unionByName(joint).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
