from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import corpus


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """A doc_id, or null, at many different texts costs none of them its row."""
    import corpus_pipeline as pipeline

    text = lambda seed: " ".join(corpus.words(60, seed))
    near = text(1).split()
    near[30] = "changed"
    rows = [(7, text(i)) for i in range(1, 6)] + [(None, text(i)) for i in range(6, 16)]
    rows += [(3, " ".join(near)), (3, text(20)), (3, text(20)), (None, text(20)), (8, text(6)), (9, "")]
    rows += [(None, None), (None, None), (None, " \t"), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, "").collect())
    want = Counter([(7, text(i)) for i in range(2, 6)] + [(None, text(i)) for i in range(7, 16)])
    want += Counter([(3, " ".join(near)), (3, text(20)), (8, text(6)), (9, ""), (None, None), (None, None), (None, " \t"), (7, "")])
    assert got == want


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def hard(spark):
    """Rows with nulls in every column, repeated rows, empty and long texts; and a clashing column."""
    rows = [r[:5] for r in corpus.rows()] + [(None,) * 5] * 3 + [(1, None, None, None, None), (2, "", "en", "", 0), (900, " ".join(corpus.words(20000, 77)), "en", "b", 7)] * 2
    return rows, spark.createDataFrame(rows, DOCS).withColumn("text_key", F.lit("x")).withColumn("_words", F.lit(1)).repartition(3)


def as_rows(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def test_quality_filter_keeps_what_scores_well(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tessera.llm import quality

    good, bad = [" ".join(corpus.words(60, i)) + "." for i in range(40)], [f"{i}!! click " * 30 for i in range(40)]
    rows, _ = hard(spark)
    rows = rows + [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(9.0)).withColumn("predicted", F.lit(0))
    labels = spark.createDataFrame([(1000 + i, int(i < 40), 0) for i in range(80)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = as_rows(pipeline.quality_filter(spark, docs, str(tmp_path)))
    net = quality.fit(docs.select("doc_id", "text"), labels)
    score = lambda t: net.scores(np.frombuffer(corpus.utf8(t), np.uint8), np.array([0, len(corpus.utf8(t))]))[0]
    assert got == Counter(r for r in rows if score(r[1]) >= 0.3)
    kept = {r[0] for r in got}
    assert len(kept & set(range(1000, 1040))) >= 36 and len(kept & set(range(1040, 1080))) <= 4
    nothing = pipeline.quality_filter(spark, docs.limit(0), str(tmp_path))
    assert nothing.count() == 0 and nothing.columns == pipeline.COLUMNS


def test_repeated_passages_are_cut_and_nothing_else(spark):
    import corpus_pipeline as pipeline

    rows, docs = hard(spark)
    want = Counter()
    for row, mask in zip(rows, corpus.removed_masks([r[1] for r in rows], 200)):
        if not any(mask):
            want[tuple(row)] += 1
        else:
            left = bytes(b for b, gone in zip(corpus.utf8(row[1]), mask) if not gone).decode("utf-8", "ignore")
            want[(row[0], left, row[2], row[3], len(left))] += 1
    assert as_rows(pipeline.repeated_passages(spark, docs, "")) == want


def test_mix_takes_what_its_plan_says(spark):
    import corpus_pipeline as pipeline
    from tessera.llm import mixing

    rows, docs = hard(spark)
    got = pipeline.mix_sources(spark, docs, "").collect()
    plan = mixing.plan_mix(docs.select(*pipeline.COLUMNS)).collect()
    size = lambda t: len(corpus.utf8(t).split())
    taken, said = Counter(), Counter()
    for r in got:
        taken[r.source] += size(r.text)
        assert size(r.text) and r.n_chars == len(r.text) or r.text in {x[1] for x in rows}
    for p in plan:
        said[p.source] += p.taken
    most = sum(size(r[1]) for r in rows)
    # Rows that repeat key, text and source share what they take, to the word below.
    assert all(abs(taken[s] - said[s]) <= 6 for s in said) and sum(said.values()) <= 2 * most
    whole = {tuple(corpus.utf8(r[1]).split()) for r in rows}
    for r in got:
        words = tuple(corpus.utf8(r.text).split())
        assert any(words == w[i : i + len(words)] for w in whole for i in range(len(w)) if w[i] == words[0])


def test_packs_hold_every_id_once(spark):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    rows, docs = hard(spark)
    encoder = Tokenizer.from_file(pipeline.TOKENIZER)
    lengths = Counter()
    for r in rows:
        lengths[r[0]] += len(encoder.encode(r[1] or "", add_special_tokens=False).ids) + 1
    found, sequences = Counter(), {}
    for r in pipeline.pack_sequences(spark, docs, "").collect():
        found[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert found == lengths
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(lengths.values()) // 4096) + 2
