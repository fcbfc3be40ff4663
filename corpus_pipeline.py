"""Corpus pipeline: quality rules, near-dedup, repeat removal, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
Rows without a doc_id can't be judged and go with the first stage.  Rows of one doc_id are judged each by its own text;
near-dedup leaves one row of a doc_id, that with the least hash of all its columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import Scratch, table
from candlewright.llm.contamination import contaminated
from candlewright.llm.minhash import near_duplicates
from candlewright.llm.packing import pack
from candlewright.llm.quality import quality
from candlewright.llm.repeats import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: SQL has no tokenizer, so the packed rows have no SQL; tests hold them against plain Python.
ORACLE_SQL = None


def copy_of(text: str = "text"):
    """Tells rows of one doc_id apart, as the operators do."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality rules reject."""
    scratch = Scratch(spark, "quality-rules")
    kept = scratch.last(quality(docs, scratch=scratch).where("kept").select(F.col("doc_id").alias("kept_id"), "copy"))
    return docs.join(kept, (F.col("doc_id") == F.col("kept_id")) & (copy_of() == F.col("copy")), "left_semi")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    scratch = Scratch(spark, "near-dedup")
    kept = scratch.last(near_duplicates(docs, scratch=scratch).where("kept").select("doc_id"))
    rows = docs.join(kept, "doc_id", "left_semi")
    least = rows.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return least.select("row.*").select(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long repeated strings out of the texts; documents of which nothing is left go."""
    cut = remove_repeats(docs).select(F.col("doc_id").alias("cut_id"), F.col("copy").alias("cut_copy"), "n_removed", F.col("kept_text").alias("cut_text"))
    cut = cut.where("n_removed = 0 OR cut_text <> ''").dropDuplicates(["cut_id", "cut_copy"])
    out = docs.join(cut, (F.col("doc_id") == F.col("cut_id")) & (copy_of() == F.col("cut_copy"))).withColumn("text", F.col("cut_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the rest into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    scratch = Scratch(spark, "pipeline-run")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
