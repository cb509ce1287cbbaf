"""Links between records: owners by containment or name, positions, references, twins.

Range joins go by key and bucket (see :mod:`intervals`); outcomes are
resolved, ambiguous or missing and no first match is picked, unless an order is the rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bucketed
from .resolve import AMBIGUOUS, MISSING, RESOLVED


def _ranges(ranges: DataFrame, key: str, start: str, end: str, width: int, *more: str) -> DataFrame:
    own = ranges.where(F.col(end) > F.col(start)).select(F.col(key).alias("rk"), F.col(start).alias("rs"), F.col(end).alias("re"), *(F.col(x).alias("r_" + x) for x in more))
    return bucketed(own, F.col("rs"), F.col("re"), width, "rb")


def inside(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, width: int, how: str = "left_semi") -> DataFrame:
    """Points that lie in some range of their key (left_anti: in none); a point counts once, however many hold it."""
    right = _ranges(ranges, key, start, end, width)
    return points.join(right, (F.col(key) == F.col("rk")) & (F.floor(F.col(at) / width) == F.col("rb")) & (F.col(at) >= F.col("rs")) & (F.col(at) < F.col("re")), how)


def overlapping(left: DataFrame, ranges: DataFrame, key: str, start: str, end: str, right_start: str, right_end: str, width: int) -> DataFrame:
    """Rows of `left`, each with whether some range of its key overlaps its own."""
    right = _ranges(ranges, key, right_start, right_end, width)
    numbered = left.withColumn("row_no", F.monotonically_increasing_id())
    cut = bucketed(numbered.where(F.col(end) > F.col(start)), F.col(start), F.col(end), width, "lb")
    hit = cut.join(right, (F.col(key) == F.col("rk")) & (F.col("lb") == F.col("rb")) & (F.col(start) < F.col("re")) & (F.col("rs") < F.col(end)), "left_semi")
    cut = cut.select(*left.columns, "row_no", F.lit(False).alias("hit"))
    flagged = cut.unionByName(hit.select(*left.columns, "row_no", F.lit(True).alias("hit")))
    empty = numbered.where(~F.coalesce(F.col(end) > F.col(start), F.lit(False))).select(*left.columns, "row_no", F.lit(False).alias("hit"))
    return flagged.unionByName(empty).groupBy(*left.columns, "row_no").agg(F.max("hit").alias("overlaps")).drop("row_no")


def first_owner(points: DataFrame, ranges: DataFrame, key: str, id_: str, at: str, start: str, end: str, owner: str, priority: list[str], width: int) -> DataFrame:
    """Points (their `id_` is unique) with the owner of the first range, by `priority`, that holds them; null without one."""
    right = _ranges(ranges, key, start, end, width, owner, *priority)
    hits = points.join(right, (F.col(key) == F.col("rk")) & (F.floor(F.col(at) / width) == F.col("rb")) & (F.col(at) >= F.col("rs")) & (F.col(at) < F.col("re")), "left")
    return hits.groupBy(id_).agg(F.min_by("r_" + owner, F.when(F.col("rk").isNotNull(), F.struct(*("r_" + x for x in priority), "r_" + owner))).alias("owner"))


def range_owner(items: DataFrame, ranges: DataFrame, key: str, id_: str, start: str, end: str, r_start: str, r_end: str, owner: str, trusted: str, width: int) -> DataFrame:
    """Items (their `id_` is unique) whose range lies within ranges: how many, and the owner if it is one and trusted."""
    right = _ranges(ranges, key, r_start, r_end, width, owner, trusted)
    hits = items.join(right, (F.col(key) == F.col("rk")) & (F.floor(F.col(start) / width) == F.col("rb")) & (F.col(start) >= F.col("rs")) & (F.col(end) <= F.col("re")), "left")
    out = hits.groupBy(id_).agg(F.count("rk").alias("n_owners"), F.min("r_" + owner).alias("one"), F.max("r_" + trusted).alias("good"))
    state = F.when((F.col("n_owners") == 1) & F.col("good"), RESOLVED).when(F.col("n_owners") > 0, AMBIGUOUS).otherwise(MISSING)
    return out.select(id_, "n_owners", F.when(state == RESOLVED, F.col("one")).alias("owner"), state.alias("status"))


def positional(df: DataFrame, target: DataFrame, key: str, number: str, order: list[str], value: str) -> DataFrame:
    """Rows with the value of the key's target row at place `number` (from 1, in `order`); 0 and places beyond the last give null."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    right = target.select(F.col(key).alias("tk"), place.alias("place"), F.col(value).alias("target"))
    return df.join(right, (F.col(key) == F.col("tk")) & (F.col(number) == F.col("place")), "left").select(*df.columns, "target")


def without_twins(df: DataFrame, other: DataFrame, left: list[Column], right: list[Column]) -> DataFrame:
    """Rows for which `other` has no row of equal keys; the two sides' keys are expressions, so an offset may be shifted."""
    keys = other.select(*(x.alias(f"twin_{i}") for i, x in enumerate(right))).distinct()
    return df.join(keys, [x == F.col(f"twin_{i}") for i, x in enumerate(left)], "left_anti")


def sheet_candidates(name: Column) -> Column:
    """Where a section's worksheet is looked for, in order: its name before `@` up to the first `_`, before `@`, up to the first `_`, the name itself, and then its beginnings before each `_` or `@`, short ones first."""
    bare = F.substring_index(name, "@", 1)
    has_at, root, plain = F.contains(name, F.lit("@")), F.substring_index(bare, "_", 1), F.substring_index(name, "_", 1)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 1, F.lit(1))), lambda i: F.when(F.substr(name, i + 1, F.lit(1)).isin("_", "@"), F.substr(name, F.lit(1), i))), lambda x: x.isNotNull())
    heads = F.array(F.when(has_at & F.contains(bare, F.lit("_")), root), F.when(has_at, bare), F.when(F.contains(name, F.lit("_")), plain), F.when(F.contains(bare, F.lit("_")), root), name)
    return F.concat(heads, cuts)


def sheet_of(sections: DataFrame, name: str, sheets: DataFrame, sheet: str) -> DataFrame:
    """Distinct section names with the worksheet that the first of their candidates names: equi joins only."""
    known = sheets.select(F.col(sheet).alias("worksheet")).distinct()
    tried = sections.select(name).distinct().select(name, F.posexplode(sheet_candidates(F.col(name))).alias("rank", "candidate")).where("candidate is not null")
    found = tried.join(known, F.col("candidate") == F.col("worksheet"), "left")
    return found.groupBy(name).agg(F.min_by("worksheet", F.when(F.col("worksheet").isNotNull(), F.col("rank"))).alias("worksheet"))


def tree_parents(nodes: DataFrame, id_: str, parent_id: str, reference: str, name: str) -> DataFrame:
    """Nodes with their parent: the node that parent_id names, else the only one that `[Parent]Child` in `reference` names."""
    by_id = nodes.select(F.col(id_).alias("pid"), F.col(name).alias("p_name"))
    by_name = nodes.groupBy(F.col(name).alias("n_name")).agg(F.count("*").alias("n"), F.min(id_).alias("n_id"))
    called = F.nullif(F.regexp_extract(F.col(reference), r"^\[([^\]]+)\]", 1), F.lit(""))
    out = nodes.join(by_id, F.col(parent_id) == F.col("pid"), "left").join(by_name, (called == F.col("n_name")) & (F.col("n") == 1), "left")
    how = F.when(F.col("pid").isNotNull(), "node_id").when(F.col("n_id").isNotNull(), "reference")
    return out.select(F.col(id_), F.coalesce("pid", "n_id").alias("parent"), how.alias("found_by"))


def bound_by_tokens(texts: DataFrame, key: str, tokens: Column, names: DataFrame, name: str, name_tokens: Column) -> DataFrame:
    """Texts with the name that shares most distinct tokens with them; ties are ambiguous.

    Tokens are distinct within a text before they meet names, so a frequent token costs a text one row a name that has it."""
    left = texts.select(key, F.explode(F.array_distinct(tokens)).alias("token"))
    right = names.select(F.col(name).alias("name"), F.explode(F.array_distinct(name_tokens)).alias("token")).distinct()
    shared = left.join(right, "token").groupBy(key, "name").agg(F.count("*").alias("n_shared"))
    top = shared.groupBy(key).agg(F.max("n_shared").alias("n_shared"), F.max_by(F.struct("name"), F.struct("n_shared", "name")).alias("last"), F.min_by(F.struct("name"), F.struct(-F.col("n_shared"), "name")).alias("first"))
    return top.select(key, "n_shared", F.when(F.col("first.name") == F.col("last.name"), F.col("first.name")).alias("name"))


def candidates(df: DataFrame, columns: list[str], sheets: DataFrame, aliases: DataFrame, sheet: str, x: str, y: str, x_no: str, y_no: str, ordinal) -> DataFrame:
    """Source slots (worksheet, x and y column, their ordinals) with the tables that have that alias and both columns, and the outcome.

    sheets: table, column; aliases: table, alias.  Ordinals that don't belong to the letters are an outcome of their own."""
    own = df.select(*columns, sheet, x, y, x_no, y_no)
    has_x, has_y = (sheets.select(F.col("table").alias("t" + k), F.col("column").alias("c" + k)).distinct() for k in "xy")
    hits = own.join(aliases.select(F.col("table").alias("ta"), F.col("alias").alias("al")).distinct(), F.col(sheet) == F.col("al"))
    hits = hits.join(has_x, (F.col("ta") == F.col("tx")) & (F.col(x) == F.col("cx"))).join(has_y, (F.col("ta") == F.col("ty")) & (F.col(y) == F.col("cy")))
    count = hits.groupBy(*(F.col(c).alias("h_" + c) for c in columns)).agg(F.count_distinct("ta").alias("n"), F.min("ta").alias("one"))
    out = own.join(count, [F.col(c) == F.col("h_" + c) for c in columns], "left")
    missing = F.col(sheet).isNull() | F.col(x).isNull() | F.col(y).isNull()
    wrong = ~(F.col(x_no).eqNullSafe(ordinal(F.col(x))) & F.col(y_no).eqNullSafe(ordinal(F.col(y))))
    state = F.when(missing, "unresolved_missing_source_fields").when(wrong, "invalid_column_ordinal_invariant").when(F.col("n") == 1, "resolved_exact").when(F.col("n") > 1, "ambiguous_exact_candidates").otherwise("unresolved")
    return out.select(*columns, state.alias("status"), F.when(state == "resolved_exact", F.col("one")).alias("table"))


def kind_by_hints(df: DataFrame, name: str, hints: DataFrame, ranks: list[str], otherwise: Column) -> DataFrame:
    """Rows with a kind: of the hints (name, kind) for their name the one that comes first in `ranks`, else what the name's rule says."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(ranks)))
    top = hints.groupBy(F.col("name").alias("h_name")).agg(F.min(rank).alias("rank"))
    of = F.element_at(F.array(*(F.lit(k) for k in ranks)), F.col("rank") + 1)
    return df.join(top, F.col(name) == F.col("h_name"), "left").select(*df.columns, F.when(F.col("rank").isNotNull(), of).otherwise(otherwise).alias("kind"))
