"""Multiset comparison of two results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often: columns, left_count, right_count."""
    both = left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*columns).agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count")).where("left_count <> right_count")


def pair_kth(left: DataFrame, right: DataFrame, bucket: list[str], order: list[str], value: str) -> DataFrame:
    """The k-th row of a bucket on one side beside the k-th on the other; leftovers are one-sided."""
    number = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    a = left.select(*bucket, number.alias("k"), F.col(value).alias("left_value"))
    b = right.select(*bucket, number.alias("k"), F.col(value).alias("right_value"))
    joined = a.join(b, [*bucket, "k"], "full")
    side = F.when(F.col("left_value").isNull(), "right_only").when(F.col("right_value").isNull(), "left_only").otherwise("both")
    return joined.withColumn("side", side)


def close(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-12) -> Column:
    """Equal within tolerance; a NaN equals nothing, infinities equal themselves."""
    inf = F.lit(float("inf"))
    same = (a == b) & ~F.isnan(a)
    near = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) != inf) & (F.abs(b) != inf) & (F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute)))
    return F.coalesce(same | near, F.lit(False))


def cell_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str, relative: float = 1e-12, absolute: float = 1e-12) -> DataFrame:
    """Cells that differ beyond tolerance or are on one side only: keys, left_value, right_value, reason."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    joined = a.join(b, keys, "full")
    reason = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").when(~close(F.col("left_value"), F.col("right_value"), relative, absolute) & ~(F.col("left_value").isNull() & F.col("right_value").isNull()), "value")
    return joined.withColumn("reason", reason).where("reason is not null").select(*keys, "left_value", "right_value", "reason")
