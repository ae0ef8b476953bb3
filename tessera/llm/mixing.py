"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: sources share ``scale`` x all words by weight. A source stops at
   ``max_repeat`` x its own size and what it cannot take is shared anew by weight.
2. Quotas: the mix is a number of equal blocks of words. Blocks go to the highest
   quotients ``target / (2k + 1)``, k = 0, 1, ... (Sainte-Laguë), so quotas are integers
   that add up to the mix.
3. Shards: a source's quota is split over its shards in proportion to their words, by
   differences of rounded running sums, so shard quotas are integers that add up.
4. Selection: inside a shard, documents are laid out in seeded order (by a digest of key and
   text, so that one key or null spreads over shards) and their words form one ring of blocks.
   A quota takes whole turns and then the run of blocks from a seeded start. Nothing is drawn
   at run time: reruns agree.

Only DataFrame functions are used. One source may hold any share of the rows: its
shards, whose number follows its size, keep every window small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import copies, written

#: What separates words: ASCII space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Blocks in a whole mix, about; the block size follows from it.
BLOCKS = 1 << 20
#: Documents of a source in one shard, about.
DOCS_PER_SHARD = 2048


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_number(text: Column, digits: int = 12) -> Column:
    """The number that the first hexadecimal digits of md5(text) spell."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def draw(key: Column, text: Column, seed: str) -> Column:
    """What decides a document's shard and place: md5 of seed, key and the md5 of its text."""
    body = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), body))


def targets(sizes: DataFrame, weights: Sequence[float], scale: float, max_repeat: float) -> DataFrame:
    """source, source_size, weight, target: one row per source in, one out.

    ``sizes`` has source and source_size. Sources are taken in code-point order, null last,
    and get ``weights`` in turn. Water filling in closed form: ``level`` is the share per
    weight left when all sources with a smaller cap / weight are full. It rises as long as
    the next source fills up and falls from there on, so its maximum is the level of all
    sources that do not fill up.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    df = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).withColumn("reach", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    rising = Window.orderBy("reach", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    df = df.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(scale)))
    df = df.withColumn("free_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), zero))
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(rising), zero)) / F.col("free_weight"))
    target = F.least(F.col("cap"), F.max("level").over(everything) * F.col("weight"))
    return df.withColumn("target", target).select("source", "source_size", "weight", "target")


def quotas(goals: DataFrame, block: int, max_repeat: float) -> DataFrame:
    """Adds quota, in words: Sainte-Laguë blocks times ``block``, at most ``max_repeat`` x the source.

    Quotients well above the last one accepted are granted unseen: a source's share
    differs from its final number of blocks by less than ``share * sources / (2 * blocks) + 2``,
    so only that many quotients of each source are listed and ranked.
    """
    everything = Window.partitionBy()
    df = goals.withColumn("goal", F.sum("target").over(everything)).withColumn("n_sources", F.count("*").over(everything))
    df = df.withColumn("blocks", F.round(F.col("goal") / F.lit(block)).cast("long"))
    share = F.when(F.col("goal") > 0, F.col("target") * F.col("blocks") / F.col("goal")).otherwise(F.lit(0.0))
    df = df.withColumn("share", share)
    slack = F.ceil(F.when(F.col("blocks") > 0, F.col("share") * F.col("n_sources") / (2 * F.col("blocks"))).otherwise(F.lit(0.0))) + 2
    df = df.withColumn("granted", F.greatest(F.lit(0), F.floor("share") - slack).cast("long")).withColumn("last", F.ceil("share") + slack)
    open_ = F.col("blocks") - F.sum("granted").over(everything)
    listed = df.withColumn("left", open_).filter(F.col("target") > 0).withColumn("k", F.explode(F.sequence("granted", F.col("last").cast("long"))))
    best = Window.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k")
    won = listed.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= F.col("left"))
    won = won.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("won"))
    joined = df.join(won, df["source"].eqNullSafe(won["_s"]), "left")
    n = F.col("granted") + F.coalesce("won", F.lit(0))
    most = F.floor(F.col("source_size") * F.lit(float(max_repeat))).cast("long")
    return joined.select("source", "source_size", "target", F.least(n * block, most).cast("long").alias("quota"))


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    scale: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """What the mix takes of every document.

    Returns key, source, size, source_size, target, draw, taken, and how: ``turns`` whole copies,
    then ``run_lo .. run_hi`` and ``wrap_hi`` words - the words ``[run_lo, run_hi)`` and
    ``[0, wrap_hi)`` of one more copy (the second part where the ring closes inside).

    Null text has no words, and nothing is taken of it; null sources are one source; a null
    key is the key ``''``; repeated rows are documents of their own; an empty table gives no
    rows. A document is taken ``max_repeat`` (a whole number) times at most.
    """
    base = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        draw(F.col(key), F.col(text), seed).alias("draw"),
    )
    base = written(base, "mix-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    sizes = written(sizes, "mix-sources")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, int(total * scale) // BLOCKS)
    goals = quotas(targets(sizes.select("source", "source_size"), weights, scale, max_repeat), block, max_repeat)
    goals = goals.join(sizes.select(F.col("source").alias("_s"), "source_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goals = written(goals.withColumnRenamed("source", "_source"), "mix-quotas")

    rows = base.join(goals, base["source"].eqNullSafe(goals["_source"])).drop("_source")
    shards = F.floor(F.col("source_docs") / DOCS_PER_SHARD) + 1
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), shards.cast("long")))

    parts = rows.groupBy("source", "shard", "quota", "source_size").agg(F.sum("size").alias("part"))
    running = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("part").over(running)
    # exact whole numbers: the product of two longs needs more than 64 bits
    ends = F.expr("cast((cast(quota as decimal(19,0)) * cast(_upto as decimal(19,0))) div nullif(source_size, 0) as long)")
    parts = parts.withColumn("_upto", upto).withColumn("_end", F.coalesce(ends, F.lit(0)))
    back = Window.partitionBy("source").orderBy("shard")
    parts = parts.withColumn("part_quota", F.col("_end") - F.coalesce(F.lag("_end").over(back), F.lit(0)))
    ring = F.floor(F.col("part") / block).cast("long")
    first = F.when(ring > 0, F.pmod(hex_number(F.concat_ws("|", F.lit(f"{seed}|start"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), ring) * block).otherwise(F.lit(0))
    parts = parts.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        F.col("part"),
        F.when(F.col("part") > 0, F.floor(F.col("part_quota") / F.col("part"))).otherwise(F.lit(0)).cast("long").alias("turns"),
        F.when(F.col("part") > 0, F.pmod(F.col("part_quota"), F.col("part"))).otherwise(F.lit(0)).alias("rest"),
        first.cast("long").alias("first"),
    )
    # Rows that are equal in all that counts are laid out as one and then get their places.
    laid = Window.partitionBy("source", "shard").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.groupBy("key", "source", "size", "draw", "source_size", "target", "shard").agg(F.count("*").alias("_m"))
    rows = rows.withColumn("lo", F.coalesce(F.sum(F.col("size") * F.col("_m")).over(laid), F.lit(0)))
    rows = rows.join(parts, rows["source"].eqNullSafe(parts["_source"]) & (rows["shard"] == parts["_shard"]))
    rows = copies(rows, "_m", "_i").withColumn("lo", F.col("lo") + F.col("_i") * F.col("size"))

    # The run [first, first + rest) on a ring of `part` words, met with [lo, lo + size):
    # once as it lies, once shifted back by a turn.
    inside = lambda value: F.least(F.greatest(value, F.lit(0)), F.col("size"))
    stop = F.col("first") + F.col("rest")
    rows = rows.select(
        "key", "source", "size", "source_size", "target", "draw", "turns",
        inside(F.col("first") - F.col("lo")).alias("run_lo"),
        inside(stop - F.col("lo")).alias("run_hi"),
        inside(stop - F.col("part") - F.col("lo")).alias("wrap_hi"),
    )
    taken = F.col("turns") * F.col("size") + (F.col("run_hi") - F.col("run_lo")) + F.col("wrap_hi")
    return rows.withColumn("taken", taken.cast("long")).withColumnRenamed("key", key).withColumnRenamed("source", source)


def mixed(docs: DataFrame, plan: DataFrame, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix: ``docs`` with each document once for every whole copy taken, and once
    more with the words of each run where a block's edge cuts it.

    A cut text is its words joined by single spaces; ``n_chars``, if there, follows the text.
    Rows are matched with their plan (of the same ``seed``) by key, text and source. Rows that
    repeat all three can't be told apart: what the plan takes of them together is taken of each
    in equal parts, to the word below.
    """
    share = F.floor(F.col("_sum") / F.col("_m"))
    planned = F.struct("_first.turns", "_first.run_lo", "_first.run_hi", "_first.wrap_hi")
    nothing = F.lit(0).cast("long")
    equal = F.struct(
        F.floor(share / F.col("_size")).alias("turns"), nothing.alias("run_lo"), F.pmod(share, F.col("_size")).alias("run_hi"), nothing.alias("wrap_hi")
    )
    of_row = (
        plan.filter("size > 0")
        .groupBy(F.col("draw").alias("_draw"), F.col(source).alias("_source"))
        .agg(F.count("*").alias("_m"), F.sum("taken").alias("_sum"), F.first("size").alias("_size"), F.first(F.struct("turns", "run_lo", "run_hi", "wrap_hi")).alias("_first"))
        .select("_draw", "_source", F.when(F.col("_m") == 1, planned).otherwise(equal).alias("_take"))
    )
    rows = docs.withColumn("_words", word_count(F.col(text))).filter("_words > 0").withColumn("_own", draw(F.col(key), F.col(text), seed))
    rows = rows.join(of_row, (F.col("_own") == F.col("_draw")) & F.col(source).eqNullSafe(F.col("_source")))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("lo"), F.col("_words").alias("hi")), F.col("_take.turns").cast("int"))
    run = F.array(F.struct(F.col("_take.run_lo").cast("long").alias("lo"), F.col("_take.run_hi").cast("long").alias("hi")), F.struct(F.lit(0).cast("long").alias("lo"), F.col("_take.wrap_hi").cast("long").alias("hi")))
    rows = rows.withColumn("_part", F.explode(F.concat(whole, F.filter(run, lambda r: r["hi"] > r["lo"]))))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})")), F.col("_part.lo").cast("int") + 1, (F.col("_part.hi") - F.col("_part.lo")).cast("int")), " ")
    rows = rows.withColumn(text, F.when((F.col("_part.lo") == 0) & (F.col("_part.hi") == F.col("_words")), F.col(text)).otherwise(cut))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast("long"))
    return rows.select(*docs.columns)
