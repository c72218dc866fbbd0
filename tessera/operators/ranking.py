"""Representative choice, duplicate groups, collision-free names, heads and tails."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import Scratch


def representative_order(issues: Column, width: Column, height: Column, size: Column, name: Column, image_id: Column) -> list[Column]:
    """Fewest issues, largest area, largest file, first name without case, first id."""
    area = F.coalesce(width, F.lit(0)).cast("bigint") * F.coalesce(height, F.lit(0)).cast("bigint")
    return [issues.asc(), area.desc(), size.desc(), F.lower(name).asc(), image_id.asc()]


def with_rank(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`place` (1 is the representative) within the keys."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def exact_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose keys occur twice or more, with `members` and `place`. Keys are counted before anything is sorted, so single rows never reach the window."""
    again = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return with_rank(df.join(again, keys), keys, order)


def best_of(issues: Column, width: Column, height: Column, size: Column, name: Column, image_id: Column) -> Column:
    """The representative order as one value: the least of a group is its representative, found by an aggregate without a sort."""
    area = F.coalesce(width, F.lit(0)).cast("bigint") * F.coalesce(height, F.lit(0)).cast("bigint")
    return F.struct(issues.alias("issues"), F.negative(area).alias("area"), F.negative(size).alias("size"), F.lower(name).alias("name"), image_id.alias("id"))


def representatives(df: DataFrame, keys: list[str], best: Column) -> DataFrame:
    """keys, representative, members of each group; `best` from `best_of`."""
    return df.groupBy(*keys).agg(F.min(best)["id"].alias("representative"), F.count(F.lit(1)).alias("members"))


def running(df: DataFrame, order: list[str], value: Column, scratch: Scratch, name: str = "before") -> DataFrame:
    """`df` with the sum of `value` over all rows that come before in `order` (which has no ties).

    Rows are dealt to ranges of the order and numbered within; the ranges' sums, one number a range, give the offsets. So no task
    sees all rows, unlike a window without keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.table(df.withColumn("_v", value.cast("bigint")).repartitionByRange(parts, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    sums, total, offsets = dict(dealt.groupBy("_r").agg(F.sum("_v")).collect()), 0, []
    for r in range(parts):
        offsets.append(total)
        total += sums.get(r) or 0
    inside = Window.partitionBy("_r").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.get(F.array(*map(F.lit, offsets)), F.col("_r"))
    return dealt.withColumn(name, offset + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_r")


def rename_collisions(df: DataFrame, folder: str, name: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """`resolved` names, unique in their folder and not among `existing` (folder, name): stem_1.ext, stem_2.ext and so on, in order.

    A name that is taken, by an earlier row, by one that was renamed or by an existing file, is counted up until it is free, so the
    result depends on the order of rows. Names that differ but in counters at the end of the stem (a.png, a_1.png, a_1_2.png) can
    meet, others never. A family of such names in which only one name occurs, and none exists, is counted by a window; only
    families of several names, where counters can meet, are handled by one task each.
    """

    def family(c: Column) -> Column:
        parts = F.regexp_extract(c, r"(?s)\A(.+?)(?:_\d+)*(\.[^.]+)?\z", 1), F.regexp_extract(c, r"(?s)\A(.+?)(\.[^.]+)?\z", 2)
        return F.concat(parts[0], F.lit("\x00"), parts[1])

    old = existing.select(F.col(folder), F.col(name)) if existing is not None else df.select(folder, name).limit(0)
    taken = old.distinct().withColumn("_family", family(F.col(name))).groupBy(folder, "_family").agg(F.collect_list(name).alias("_taken"))
    rows = df.withColumn("_family", family(F.col(name)))
    kinds = rows.groupBy(folder, "_family").agg((F.min(name) != F.max(name)).alias("_several"), F.count(F.lit(1)).alias("_n"))
    kinds = kinds.join(taken, [folder, "_family"], "left").withColumn("_several", F.col("_several") | F.col("_taken").isNotNull())
    rows = rows.join(kinds, [folder, "_family"])
    columns = df.columns
    # Of a lone name the first keeps it and the others count up. A leading or a last dot begins no suffix.
    alone, n = rows.where("not _several"), F.col(name)
    dotted = n.rlike(r"(?s)\A.+\.[^.]+\z")
    stem, suffix = F.when(dotted, F.regexp_extract(n, r"(?s)\A(.+)(\.[^.]+)\z", 1)).otherwise(n), F.when(dotted, F.regexp_extract(n, r"(?s)\A(.+)(\.[^.]+)\z", 2)).otherwise("")
    k = F.when(F.col("_n") > 1, F.row_number().over(Window.partitionBy(folder, "_family").orderBy(*[F.col(c).asc_nulls_last() for c in order])) - 1).otherwise(0)
    alone = alone.withColumn("_k", k).select(*columns, F.when(F.col("_k") == 0, n).otherwise(F.concat(stem, F.lit("_"), F.col("_k").cast("string"), suffix)).alias("resolved"), F.lit(False).alias("met_existing"))
    rows = rows.where("_several")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        first = pdf["_taken"].iloc[0]
        old = set(first) if first is not None and len(first) else set()
        used, out, was, next_of = set(old), [], [], {}
        for n in pdf[name]:
            was.append(n in old)
            if n in used:
                dot = n.rfind(".")
                stem, suffix = (n[:dot], n[dot:]) if 0 < dot < len(n) - 1 else (n, "")
                k = next_of.get(n, 1)  # names below have been found taken before
                while f"{stem}_{k}{suffix}" in used:
                    k += 1
                next_of[n] = k
                n = f"{stem}_{k}{suffix}"
            used.add(n)
            out.append(n)
        return pdf[columns].assign(resolved=out, met_existing=was)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", resolved string, met_existing boolean"
    return alone.unionByName(rows.groupBy(folder, "_family").applyInPandas(run, schema))


def head(df: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n).orderBy(*order)
