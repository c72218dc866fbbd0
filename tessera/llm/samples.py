"""Bounded samples of labelled rows for fitting, chosen by a hash of the id so that they do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1_000_000


def by_hash(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About `most` of the rows (all, if there are no more), by hash of the id. One cheap count over the given columns comes first."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(GRAIN)) < int(GRAIN * most / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, label of a sample of at most about `most` labelled rows that `train` (a condition on the id) admits.

    Only ids and labels are counted and sampled; the sample, bounded by `most`, is then broadcast to the scan of texts. Rows whose
    id or label is null are left out; of an id with several labels the smallest counts.
    """
    known = labels.select(F.col(id_col), F.col(label).cast("int").alias("label")).where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & train)
    known = by_hash(known, id_col, most).groupBy(id_col).agg(F.min("label").alias("label"))
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(known), id_col)
