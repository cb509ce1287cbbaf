"""Which rows of a group stay: greedy choices, trims, best candidates, first sights.

Greedy choices carry their state along a key's sorted rows (:func:`_along`), so a
key is one task's stream; what a built-in aggregate or window can say is one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(df: DataFrame, key: str, order: list[Column], walk: Callable) -> DataFrame:
    """Rows that `walk` keeps of each key's sorted rows; it is made anew for each key, takes row after row and gives rows back, at the end those it still holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step, names = object(), None, None
        for batch in batches:
            names, out = list(batch.columns), []
            for row in batch.itertuples(index=False, name=None):
                k = row[names.index(key)]
                if k != now:
                    if step is not None:
                        out += step(None)
                    now, step = k, walk(names)
                out += step(row)
            yield pd.DataFrame(out, columns=names).astype(batch.dtypes)
        if step is not None:
            yield pd.DataFrame(step(None), columns=names).astype(batch.dtypes)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, df.schema)


def longest_first(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Ranges taken by length, the longest first (of equal ones the first by start and tie), unless they overlap one that is taken.

    The state is the taken ranges of a key, in order; they don't overlap, so two neighbours decide."""

    def walk(names):
        a, b, taken = names.index(start), names.index(end), []

        def step(row):
            if row is None:
                return []
            i = bisect_left(taken, (row[a], row[b]))
            if i < len(taken) and taken[i][0] < row[b] or i and taken[i - 1][1] > row[a]:
                return []
            taken.insert(i, (row[a], row[b]))
            return [row]

        return step

    return _along(df, key, [(F.col(end) - F.col(start)).desc(), F.col(start), F.col(tie)], walk)


def containing_wins(df: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Ranges by start, longer ones first: one inside the last kept is dropped, one that reaches beyond it takes its place."""

    def walk(names):
        a, b, last = names.index(start), names.index(end), None

        def step(row):
            nonlocal last
            if row is None:
                return [last] if last is not None else []
            if row[b] <= row[a] or (last is not None and row[b] <= last[b]):
                return []
            before, last = last, row
            return [before] if before is not None and before[b] <= row[a] else []

        return step

    return _along(df, key, [F.col(start), (F.col(end) - F.col(start)).desc(), F.col(tie)], walk)


def first_seen(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each group with the place where each is first seen: a partial aggregate, no window."""
    return df.groupBy(*group, value).agg(F.min(order).alias("first_at"))


def trim_trailing(df: DataFrame, key: str, order: str, marker: Column) -> DataFrame:
    """Rows up to a key's last one that is no marker."""
    last = df.groupBy(key).agg(F.max(F.when(~F.coalesce(marker, F.lit(False)), F.col(order))).alias("last"))
    return df.join(last.withColumnRenamed(key, "of"), F.col(key).eqNullSafe(F.col("of")) & (F.col(order) <= F.col("last"))).select(*df.columns)


def extended_starts(df: DataFrame, key: str, start: str, end: str, prelude: Column, near: int = 64, far: int = 512) -> DataFrame:
    """Starts moved back to the end of the key's row before, if the gap is at most `near`, or positive and at most `far` behind a prelude."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    gap = F.col(start) - F.col("previous_end")
    moved = gap.between(0, near) | ((gap > 0) & (gap <= far) & prelude)
    return df.withColumn("previous_end", before).withColumn("extended_start", F.when(moved, F.col("previous_end")).otherwise(F.col(start))).drop("previous_end")


def best(df: DataFrame, group: list[str], score: list[Column], columns: list[str]) -> DataFrame:
    """One row of each group, the one of the least score: a partial aggregate."""
    return df.groupBy(*group).agg(F.min_by(F.struct(*columns), F.struct(*score)).alias("row")).select(*group, "row.*")


def record_ends(df: DataFrame, key: list[str], at: str, most: int) -> DataFrame:
    """Each record's end: the next record's start, at most `most` on."""
    following = F.lead(at).over(Window.partitionBy(*key).orderBy(at))
    return df.withColumn("record_end", F.least(F.coalesce(following, F.col(at) + most), F.col(at) + most))


def kinds_with_parser_rows(df: DataFrame, kind: str, parser: Column, required: list[str]) -> DataFrame:
    """Rows without a parser go where their kind has parser rows, and where the kind requires them.

    Kinds are few: their flags are an aggregate that is joined back."""
    flags = df.groupBy(kind).agg(F.max(parser).alias("has")).withColumnRenamed(kind, "of")
    joined = df.join(flags, F.col(kind).eqNullSafe(F.col("of")))
    return joined.where(parser | ~(F.col("has") | F.coalesce(F.col(kind).isin(required), F.lit(False)))).select(*df.columns)
