"""Interval operators on half-open ranges, always within a key.

Range joins have an equality on the key and, for long axes, on a bucket of the
axis (:func:`bucketed`), so that no task sees a whole key's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows_to_next(df: DataFrame, key: str, at: str, tie: list[str], end: Column | None = None, out: str = "window_end") -> DataFrame:
    """Each row's window from its place to the next row's of the key; the last one ends at `end`."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, *tie))
    return df.withColumn(out, F.coalesce(following, end) if end is not None else following)


def merged(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching ranges of a key as one: key, start, end, n_merged."""
    order = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(key, start, end).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def gaps(df: DataFrame, key: str, start: str, end: str, low: Column, high: Column, least: Column) -> DataFrame:
    """Uncovered ranges of at least `least` within [low, high) of each key; low and high are aggregates' columns of `df`."""
    order = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.select(key, F.coalesce(F.max(end).over(order), low).alias("gap_start"), F.col(start).alias("gap_end"))
    tail = df.groupBy(key).agg(F.max(end).alias("gap_start"), F.max(high).alias("gap_end"))
    both = inner.unionByName(tail)
    return both.where(F.col("gap_end") - F.col("gap_start") >= least)


def sweep(df: DataFrame, key: str, start: str, end: str, rank: str, ranks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Cut at every boundary; each segment gets the highest rank that covers it (0: none), and equal neighbours are merged.

    One pass over boundaries: a running count of open ranges per rank, no range join.  `ranks` are all ranks there are, ascending; a row with another one is an error."""
    known = F.when(F.col(rank).isin(*ranks), F.col(rank)).otherwise(F.raise_error(F.lit("a rank that the sweep isn't told of")).cast("int"))
    opening = df.where(F.col(end) > F.col(start)).select(key, F.col(start).alias("at"), known.alias("_r"), F.lit(1).alias("_d"))
    closing = df.where(F.col(end) > F.col(start)).select(key, F.col(end).alias("at"), known.alias("_r"), F.lit(-1).alias("_d"))
    marks = opening.unionByName(closing).groupBy(key, "at").agg(*[F.sum(F.when(F.col("_r") == r, F.col("_d")).otherwise(0)).alias(f"_d{r}") for r in ranks])
    order = Window.partitionBy(key).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = marks.select(key, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), *[F.sum(f"_d{r}").over(running).alias(f"_o{r}") for r in ranks]).where(F.col("end").isNotNull())
    top = F.coalesce(*[F.when(F.col(f"_o{r}") > 0, F.lit(r)) for r in reversed(ranks)], F.lit(0))
    classed = cut.select(key, "start", "end", top.alias("rank"))
    order = Window.partitionBy(key).orderBy("start")
    marked = classed.withColumn("_new", F.when(F.lag("rank").over(order) == F.col("rank"), 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("rank").alias("rank")).drop("_island")


def bucketed(df: DataFrame, start: Column, end: Column, width: int, name: str = "_bucket") -> DataFrame:
    """A row for each bucket of `width` that [start, end) touches; start and end are integers."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width))))


def contained_in_one(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, owner: str, width: int) -> DataFrame:
    """Points with the one range of their key that holds them: owner if it is one, and how many there are.

    A point's bucket is in one task, so its hits are counted there, before the exchange."""
    columns = points.columns
    left = points.withColumns({"_id": F.monotonically_increasing_id(), "_bucket": F.floor(F.col(at) / width)})
    right = bucketed(ranges.select(F.col(key).alias("_key"), start, end, owner).where(F.col(end) > F.col(start)), F.col(start), F.col(end), width, "_b")
    hits = left.join(right, (left[key] == right["_key"]) & (left["_bucket"] == right["_b"]) & (left[at] >= right[start]) & (left[at] < right[end]), "left")
    out = hits.groupBy(*columns, "_id").agg(F.count(owner).alias("n_owners"), F.min(owner).alias("_owner"))
    return out.select(*columns, "n_owners", F.when(F.col("n_owners") == 1, F.col("_owner")).alias("owner"))


def overlap_counts(left: DataFrame, right: DataFrame, key: str, left_range: tuple[str, str], right_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of ranges of one key that overlap, with the overlap; each pair once, from the bucket where it begins."""
    a = bucketed(left, F.col(left_range[0]), F.col(left_range[1]), width, "_ba")
    b = bucketed(right.withColumnRenamed(key, "_key"), F.col(right_range[0]), F.col(right_range[1]), width, "_bb")
    low, high = F.greatest(left_range[0], right_range[0]), F.least(left_range[1], right_range[1])
    joined = a.join(b, (a[key] == b["_key"]) & (F.col("_ba") == F.col("_bb")) & (F.col(left_range[0]) < F.col(right_range[1])) & (F.col(right_range[0]) < F.col(left_range[1])))
    return joined.where(F.floor(low / width) == F.col("_ba")).withColumn("overlap", high - low).drop("_key", "_ba", "_bb")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, right_value: str, tie: str) -> DataFrame:
    """`left` with the latest `right` value of its key at or before its place: one sort of both, no join."""
    columns = left.columns
    a = left.select(F.struct(*columns).alias("_row"), F.col(key).alias("_k"), F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_at].dataType).alias("_v_at"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(right_value).alias("_v"), F.col(right_at).alias("_v_at"), F.col(tie).alias("_tie"))
    order = Window.partitionBy("_k").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    out = both.withColumns({"as_of_value": F.last("_v", ignorenulls=True).over(order), "as_of_at": F.last("_v_at", ignorenulls=True).over(order)})
    return out.where("_side = 1").select("_row.*", "as_of_value", "as_of_at")


def suppress_overlaps(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Ranges kept by offset: one that starts before the end of the last kept one is dropped.

    The state is the last kept row, which no running maximum gives; a sorted pass over partitions carries it across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, limit = object(), None
        for batch in batches:
            keep = []
            for k, a, b in zip(batch[key], batch[start], batch[end]):
                if k != now:
                    now, limit = k, None
                good = limit is None or a >= limit
                keep.append(good)
                if good:
                    limit = b
            yield batch[keep]

    return df.repartition(key).sortWithinPartitions(key, start, tie).mapInPandas(run, df.schema)
