"""One query per corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.records import token_records

    return token_records(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op2_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.chat import chat_turns

    return chat_turns(table(spark, sf_dir, "conversations"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), with_ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of the documents as files; the path's last part names the document."""
    from candlewright.llm.licenses import as_files, licences

    found = licences(as_files(table(spark, sf_dir, "documents")))
    return found.select(F.element_at(F.split("path", r"\."), -1).try_cast("long").alias("doc_id"), "path", "license", "origin", "score", "directory")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.contamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("js_chars", "js_words", "copy")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.simhash import near_fingerprints

    return near_fingerprints(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from candlewright.llm.variants import variants

    return variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_records, op2_chat_turns, op3_packing, op4_language_id, op5_licenses, op6_minhash, op7_decontamination, op8_toxicity, op9_quality, op10_suffix_dedup, op11_whitening, op12_simhash, op13_variants)
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    from candlewright.llm import quality

    return {"op9_quality": quality.ORACLE}
