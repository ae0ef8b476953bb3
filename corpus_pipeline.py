"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All stages
but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars).

Null and empty texts are scored like others, are nobody's near-duplicate, hold no repeats
and no words, so the mix leaves them out. An empty table passes through as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, near_dedup, packing, quality, repeats
from tessera.llm.scratch import small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, scores at 0.3 or more."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, net, COLUMNS, threshold=0.3).filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The one with the smallest doc_id stays, null last; rows that repeat its doc_id and text
    stay once. A doc_id that several groups share, or null, costs none of them its document.
    Documents without words all stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_dedup.near_duplicates(docs, shingle_words=5, percent=80)
    kept = small(written(found.survivors, "survivors").select(F.col("doc_id").alias("_kept"), F.col("text_key").alias("_kept_key")))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(has_words).withColumn("text_key", repeats.text_key(F.col("text")))
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("text_key") == F.col("_kept_key")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS).unionByName(docs.filter(~has_words))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that also occur elsewhere."""
    docs = docs.select(*COLUMNS)
    changed = repeats.cut(docs, repeats.repeated_spans(docs, 200)).select("text_key", "kept_text")
    rows = docs.withColumn("text_key", repeats.text_key(F.col("text"))).join(changed, "text_key", "left")
    rows = rows.withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long")))
    return rows.withColumn("text", F.coalesce("kept_text", "text")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: a row for every whole copy and every run of words that it takes."""
    docs = docs.select(*COLUMNS)
    plan = mixing.plan_mix(docs)
    return mixing.mixed(docs, plan).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed texts and their places in sequences of 4096 ids."""
    return packing.pack(docs, TOKENIZER, end_id=1, capacity=4096)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL cannot express the trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
