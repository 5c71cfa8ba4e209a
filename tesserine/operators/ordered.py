"""Order-dependent operators that keep working when one key holds a large part of all rows.

A plain window over a key is one task for the whole key. Here rows are cut into buckets of their order column; windows run
inside buckets, and only one row a bucket is ordered over the key to carry counts and last values across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _bucketed(df: DataFrame, order: str, bucket: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(order) / bucket))


def running_sum(df: DataFrame, by: list[str], order: str, value: Column, name: str, then: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same key before this one (by order, then the columns of `then`)."""
    rows = _bucketed(df.withColumn("_v", value), order, bucket)
    line = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*by, "_b").agg(F.sum("_v").alias("_s")).select(*by, "_b", F.coalesce(F.sum("_s").over(line), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*by, "_b").orderBy(order, *(then or [])).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_w", F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(offsets, [*by, "_b"])
    return out.withColumn(name, F.col("_o") + F.col("_w")).drop("_b", "_v", "_o", "_w")


def numbered(df: DataFrame, by: list[str], order: str, name: str, then: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """df with `name`: 0, 1, 2 ... in every key, dense."""
    return running_sum(df, by, order, F.lit(1), name, then, bucket)


def runs(df: DataFrame, by: list[str], order: str, value: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """df with `name`: the order value at which the run of equal neighbouring values began that the row is in.

    Nulls equal each other. The same value after another one starts a new run.
    """
    rows = _bucketed(df.withColumn("_p", F.struct(F.col(value).alias("v"))), order, bucket)
    inside = Window.partitionBy(*by, "_b").orderBy(order)
    line = Window.partitionBy(*by).orderBy("_b")
    last = rows.groupBy(*by, "_b").agg(F.max_by("_p", order).alias("_l")).select(*by, "_b", F.lag("_l").over(line).alias("_before"))
    rows = rows.join(last, [*by, "_b"]).withColumn("_prev", F.coalesce(F.lag("_p").over(inside), F.col("_before")))
    rows = rows.withColumn("_start", F.when(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.col("_p")), F.col(order)))
    carried = rows.groupBy(*by, "_b").agg(F.max("_start").alias("_m")).select(*by, "_b", F.max("_m").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_s", F.max("_start").over(upto)).join(carried, [*by, "_b"])
    return out.withColumn(name, F.coalesce("_s", "_c")).drop("_b", "_p", "_before", "_prev", "_start", "_s", "_c")


def neighbours(df: DataFrame, by: list[str], order: str, around: int, columns: list[str]) -> DataFrame:
    """df with `context`: the rows from `around` before to `around` behind (the row itself included), in order.

    Rows are numbered densely first and meet by number, so no key is ordered as a whole in one task.
    """
    rows = numbered(df, by, order, "_n")
    near = rows.select(*by, F.explode(F.sequence(F.col("_n") - around, F.col("_n") + around)).alias("_n"), F.struct(F.col("_n").alias("at"), *columns).alias("_c"))
    context = near.groupBy(*by, "_n").agg(F.array_sort(F.collect_list("_c")).alias("context"))
    return rows.join(context, [*by, "_n"]).drop("_n")
