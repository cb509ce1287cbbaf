"""Reshaping between columns, rows, matrices and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def transpose(cells: DataFrame, row: str, column: str, value: str, names: list) -> DataFrame:
    """Long cells as one row per `row`; the column names are given, so there is no pass to find them."""
    return cells.groupBy(row).pivot(column, names).agg(F.first(value))


def matrix(df: DataFrame, key: str, values: str, columns: int) -> DataFrame:
    """Flat values as cells of rows of `columns`: key, row, col, value."""
    return df.select(key, F.posexplode(values).alias("pos", "value")).select(key, F.floor(F.col("pos") / columns).cast("int").alias("row"), (F.col("pos") % columns).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def kinds(df: DataFrame, group: str, kind: str) -> DataFrame:
    """A group's value type from the kinds of its cells: empty, one kind, or mixed."""
    own = df.groupBy(group).agg(F.count(kind).alias("n_cells"), F.min(kind).alias("_a"), F.max(kind).alias("_b"))
    return own.select(group, "n_cells", F.when(F.col("n_cells") == 0, "empty").when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("mixed").alias("value_type"))


def tree(levels: list[tuple[DataFrame, str, str | None, str]]) -> DataFrame:
    """Nodes of a tree given level by level: (frame, id, parent id, name) -> level, id, path.

    The depth is that of the list, so each level is one join on its parent."""
    out, above = None, None
    for depth, (df, node, parent, name) in enumerate(levels):
        if above is None:
            here = df.select(F.lit(depth).alias("level"), F.col(node).cast("bigint").alias("id"), F.col(name).alias("path"))
        else:
            up = above.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
            here = df.join(up, F.col(parent).cast("bigint") == F.col("_up")).select(F.lit(depth).alias("level"), F.col(node).cast("bigint").alias("id"), F.concat("_path", F.lit("/"), F.col(name)).alias("path"))
        out, above = here if out is None else out.unionByName(here), here
    return out


def value_shapes(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """How a column's values lie: stored, missing, missing at the end, and equal to the first stored one from the start on.

    Two aggregates a column, no window: where stored values end and begin, and where one first differs."""
    some = F.col(value).isNotNull()
    head = df.groupBy(F.col(key).alias("of")).agg(F.count("*").alias("n"), F.count(value).alias("stored"), F.max(F.when(some, F.col(at))).alias("last_at"), F.min_by(value, F.when(some, F.col(at))).alias("head"))
    both = df.join(head, F.col(key).eqNullSafe(F.col("of")))
    change = both.groupBy(key).agg(F.min(F.when(~F.col(value).eqNullSafe(F.col("head")), F.col(at))).alias("change"), F.count_if(F.col("last_at").isNull() | (F.col(at) > F.col("last_at"))).alias("trailing_missing"), F.first("n").alias("n"), F.first("stored").alias("stored"))
    again = df.join(change.withColumnRenamed(key, "of"), F.col(key).eqNullSafe(F.col("of")))
    return again.groupBy(key).agg(F.first("stored").alias("stored"), F.first(F.col("n") - F.col("stored")).alias("missing"), F.first("trailing_missing").alias("trailing_missing"), F.count_if(F.col("change").isNull() | (F.col(at) < F.col("change"))).alias("repeated_prefix"))


def numeric_columns(df: DataFrame, key: str, order: str, cell: str, first: int) -> DataFrame:
    """Whether the first cells of a column that aren't blank all are numbers."""
    some = df.where(F.length(F.trim(cell)) > 0).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= first)
    return some.groupBy(key).agg(F.min(F.col(cell).try_cast("double").isNotNull()).alias("numeric"))


def overlay(base: DataFrame, top: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Both maps' keys, with the values of `top` where it has the key."""
    a = base.select(*(F.col(k).alias("a_" + k) for k in keys), *(F.col(v).alias("a_" + v) for v in values))
    joined = a.join(top.withColumn("overlaid", F.lit(True)), [F.col("a_" + k) == F.col(k) for k in keys], "full")
    over = F.coalesce("overlaid", F.lit(False))
    return joined.select(*(F.coalesce(k, "a_" + k).alias(k) for k in keys), *(F.when(over, F.col(v)).otherwise(F.col("a_" + v)).alias(v) for v in values), over.alias("overlaid"))


def zipped(df: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """Lists side by side, as far as the shortest goes, with a row number from 1; a key with an empty list has no rows."""
    n = F.least(*(F.size(x) for x in lists))
    return df.where(n > 0).select(key, F.posexplode(F.arrays_zip(*(F.slice(x, F.lit(1), n).alias(x) for x in lists))).alias("pos", "v")).select(key, (F.col("pos") + 1).alias("row_no"), *(F.col("v")[x].alias(x) for x in lists))


def paths(nodes: DataFrame, node: str, parent: str, name: str) -> DataFrame:
    """Folders with their path from the root and their depth: id, path, depth.  Nodes that no root leads to are left out; a cycle that a root leads to is an error.

    Chains of folders double each round: one that ends below node `up` is joined to those of `up`.  So there are as many joins as the depth has binary digits,
    and each round is written once.  A round that adds no path leaves only cycles; chains whose last parent is missing are dropped by the join."""
    own = nodes.select(F.col(node).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("up"), F.col(name).alias("path"), F.lit(0).alias("depth"))
    chains = written(own, "chains")
    total, reach = chains.count(), 1
    done, open_ = chains.where("up IS NULL"), chains.where("up IS NOT NULL")
    while True:
        above = done.unionByName(open_).where("id IS NOT NULL").select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        longer = open_.join(above.hint("merge"), F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), F.concat("_path", F.lit("/"), "path").alias("path"), (F.col("_depth") + F.col("depth") + 1).alias("depth"))
        chains = written(longer, "chains")
        rooted = chains.where("up IS NULL")
        if rooted.isEmpty():
            return done.select("id", "path", "depth")
        if reach > total:
            raise ValueError("a root leads to a cycle of nodes")
        done, open_, reach = done.unionByName(rooted), chains.where("up IS NOT NULL"), reach * 2


def branches(leaves: DataFrame, folder: str) -> DataFrame:
    """Branches of a tree of leaves by their folders' paths: path, parent, depth, and how many leaves lie right in it."""
    own = leaves.groupBy(F.col(folder).alias("path")).agg(F.count("*").alias("own"))
    parts = F.split("path", "/")
    up = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth"), F.when(i == F.size(parts), F.col("own")).otherwise(0).alias("own")))).alias("b")).select("b.*")
    all_ = up.groupBy("path", "depth").agg(F.sum("own").alias("n_leaves"))
    return all_.select("path", F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")).alias("parent"), "depth", "n_leaves")


def region(cells: DataFrame, row: str, column: str, value: str, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """A rectangle of a table as tab-separated lines, one a row that has cells in it."""
    own = cells.where(F.col(row).between(top, bottom) & F.col(column).between(left, right)).groupBy(row).pivot(column, list(range(left, right + 1))).agg(F.first(value))
    return own.select(row, F.concat_ws("\t", *(F.coalesce(F.col(str(k)), F.lit("")) for k in range(left, right + 1))).alias("line"))


def jsonl(df: DataFrame, file: str, columns: list[str], order: list[str]) -> DataFrame:
    """JSON lines of each file: a header record (line 0) with the columns and the number of rows, then a record a row."""
    number = F.row_number().over(Window.partitionBy(file).orderBy(*order))
    rows = df.select(F.col(file).alias("file"), number.cast("bigint").alias("line_no"), F.to_json(F.struct(*columns)).alias("line"))
    heads = df.groupBy(F.col(file).alias("file")).agg(F.count("*").alias("rows")).select("file", F.lit(0).cast("bigint").alias("line_no"), F.to_json(F.struct(F.array(*(F.lit(c) for c in columns)).alias("columns"), "rows")).alias("line"))
    return heads.unionByName(rows)


def canonical(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """The fields of a fixed list, in its order; one that `df` hasn't is null."""
    return df.select(*(F.col(n).cast(kind).alias(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n, kind in fields))
