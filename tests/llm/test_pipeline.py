"""The pipeline's stages on a small corpus, against plain Python."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import frame, words


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    item, passage = words(rng, 40), " ".join(words(rng, 60))
    clean = {i: " ".join(words(rng, 120)) for i in range(10)}
    rows = list(clean.items()) + [(20, clean[0]), (21, clean[1].replace(clean[1].split()[5], "other")), (30, "too short"), (31, None), (32, "*** $$$ ### " * 60)]
    rows += [(40 + k, " ".join(words(rng, 80)) + "\n" + passage + "\n" + " ".join(words(rng, 60))) for k in range(3)] + [(50, " ".join(words(rng, 70) + item + words(rng, 70)))]
    frame(spark, rows).drop("n", "text_2", "kept").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    keep = set(range(10)) | {40, 41, 42}
    assert seen["quality_rules"] == keep | {20, 21, 50}
    assert seen["near_dedup"] == seen["repeat_removal"] == keep | {50}
    assert seen["decontamination"] == seen["packing"] == keep
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/repeat_removal").collect()}
    assert all(left[i] == clean[i] for i in range(10)) and all(passage[20:-20] not in left[i] for i in (40, 41, 42))
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert all(r["n"] == r["all"] for r in pieces)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "repeat_removal", "decontamination", "packing"]


def test_stages_on_rows_of_one_document(spark, tmp_path):
    """Rows of one doc_id: each judged by its own text, one left by near-dedup, none multiplied."""
    rng = random.Random(22)
    a, b = (" ".join(words(rng, 120)) for _ in range(2))
    passage = " ".join(words(rng, 60))
    rows = [(1, a), (1, "too short"), (1, a), (2, b), (2, b), (None, a)]
    docs = frame(spark, rows).drop("n", "text_2", "kept")
    assert sorted(r["text"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == sorted([a, a, b, b])
    for order in (rows, rows[::-1]):
        kept = corpus_pipeline.near_dedup(spark, frame(spark, order).drop("n", "text_2", "kept").where("text <> 'too short' AND doc_id IS NOT NULL"), "").collect()
        assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (2, b)]
    twice = frame(spark, [(5, a + passage), (5, b + passage), (5, a + passage), (6, b)]).drop("n", "text_2", "kept")
    left = corpus_pipeline.repeat_removal(spark, twice, "")
    assert left.columns == twice.columns and left.collect() == []  # every text is repeated in another
    apart = frame(spark, [(5, a), (5, b), (6, passage * 1)]).drop("n", "text_2", "kept")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in corpus_pipeline.repeat_removal(spark, apart, "").collect()) == sorted([(5, a, len(a)), (5, b, len(b)), (6, passage, len(passage))])


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = frame(spark, []).drop("n", "text_2", "kept")
    spark.createDataFrame([(0, "some item of a few words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
