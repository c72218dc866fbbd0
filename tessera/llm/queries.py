"""The registered queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, langid, near_dup, packing, quality_mil, quality_rules, suffix_tree, toxicity_fm, warc
from .common import documents, remainder


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(spark, documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(spark, documents(spark, sf_dir))


def op5_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), remainder(F.col("doc_id"), 5) == 0
    model = quality_mil.train(docs, labels_table(spark, sf_dir), ~held)
    return quality_mil.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_and_compare(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held)
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), remainder(F.col("doc_id"), 3) == 1
    model = toxicity_fm.train(docs, labels_table(spark, sf_dir), ~held)
    return toxicity_fm.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_near_dup": op4_near_dup,
    "op5_quality_mil": op5_quality_mil,
    "op6_fingerprints": op6_fingerprints,
    "op7_language_id": op7_language_id,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity_fm": op10_toxicity_fm,
}

ORACLES: dict[str, str] = {
    "op4_near_dup": near_dup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_quality_rules": quality_rules.rule_sql(),
}
