"""The training-data pipeline: quality rules, language identification, near-duplicate removal, packing.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs; all but the last return the columns of `docs`, whatever their names. A stage works on all that its
predecessor kept, and each row has its own verdict, so repeated rows share theirs until near-duplicate removal leaves one of them.

Null, empty and blank texts have no words: the quality rules reject them. A null language is no label to learn from, but its text is
judged like any other; where no language can be learnt nothing is kept. Rows without an id stay, as nothing can name them as copies; of
rows with one id one stays (of the same text, unless ids are not unique, when either may). An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, near_dup, packing, quality_rules
from tessera.llm.common import Scratch, documents
from tessera.llm.queries import vocabulary

#: Least probability of the language found; below it a text is in no language that was learnt.
SURE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. The verdict is made from the row, so nothing is joined.

    The row is handed on by a generator, not a filter: a filter would be pushed down through the chain of projections and repeat
    every one of their expressions wherever it is used.
    """
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    rows = quality_rules.apply_rules(named, id_col="_row", text_col="_text")
    return rows.select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_kept")).where(F.col("_kept").isNotNull()).select("_kept.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learnt from the labelled ones: neither `und` nor unsure."""
    model = langid.train(docs, F.lit(True))
    return langid.keep(docs, model, SURE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; of rows with the same id one. Rows without an id stay."""
    kept = near_dup.classes(spark, docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one_each = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one_each.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("language_id", language), ("near_dedup", near_duplicates), ("packing", pack)]

#: Language identification and packing are not expressible in SQL; the tests compare run() with a plain re-computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
