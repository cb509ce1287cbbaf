"""Lookups that resolve only if the match is unique, and set containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLVED, AMBIGUOUS, MISSING = "resolved", "ambiguous", "missing"


def unique_targets(right: DataFrame, keys: list[str], target: str) -> DataFrame:
    """Each key's number of distinct targets and, if it is one, the target."""
    return right.where(F.col(target).isNotNull()).groupBy(*keys).agg(F.min(target).alias("_low"), F.max(target).alias("_high")).select(
        *keys, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("_target"), F.lit(True).alias("_found")
    )


def resolve(left: DataFrame, right: DataFrame, keys: list[str], target: str, out: str = "target", status: str = "status") -> DataFrame:
    """`left` with the target that `right` has for its keys, and whether it is resolved, ambiguous or missing.

    Ambiguity is an outcome: no first match is picked."""
    names = unique_targets(right, keys, target)
    names = names.select(*[F.col(k).alias("_k_" + k) for k in keys], "_target", "_found")
    joined = left.join(names, [left[k] == names["_k_" + k] for k in keys], "left")
    state = F.when(F.col("_target").isNotNull(), RESOLVED).when(F.col("_found"), AMBIGUOUS).otherwise(MISSING)
    return joined.select(*[left[c] for c in left.columns], F.col("_target").alias(out), state.alias(status))


def resolve_first(left: DataFrame, lookups: list[tuple[DataFrame, list[str], str]], out: str = "target", how: str = "resolved_by") -> DataFrame:
    """The first lookup that resolves gives the target; `how` is its number from 1, null if none does."""
    current = left
    for i, (right, keys, target) in enumerate(lookups):
        current = resolve(current, right, keys, target, f"_t{i}", f"_s{i}")
    number = F.coalesce(*[F.when(F.col(f"_t{i}").isNotNull(), F.lit(i + 1)) for i in range(len(lookups))])
    return current.select(*left.columns, F.coalesce(*[F.col(f"_t{i}") for i in range(len(lookups))]).alias(out), number.alias(how))


def containing_groups(df: DataFrame, group: str, member: str, required: list) -> DataFrame:
    """Groups whose members include all of `required` (relational division)."""
    wanted = df.where(F.col(member).isin(required)).groupBy(group).agg(F.count_distinct(member).alias("n_matched"))
    return wanted.where(F.col("n_matched") == len(set(required)))


def all_in_one_dictionary(df: DataFrame, group: str, value: str, dictionary: DataFrame, key: str, name: str) -> DataFrame:
    """Groups for which exactly one dictionary holds every distinct value."""
    values = df.select(group, value).where(F.col(value).isNotNull()).distinct()
    size = values.groupBy(group).agg(F.count("*").alias("_size"))
    hits = values.join(dictionary.select(F.col(key).alias(value), F.col(name).alias("dictionary")).distinct(), value).groupBy(group, "dictionary").agg(F.count("*").alias("_hits"))
    full = hits.join(size, group).where("_hits = _size").groupBy(group).agg(F.min("dictionary").alias("dictionary"), F.count("*").alias("_n"), F.first("_size").alias("n_values"))
    return full.where("_n = 1").select(group, "dictionary", "n_values")


def clean_groups(df: DataFrame, group: str, ordinal: str, bad: Column) -> DataFrame:
    """Groups whose ordinals are 1..N, each once, without a bad row."""
    stats = df.groupBy(group).agg(F.count("*").alias("n_rows"), F.min(ordinal).alias("_low"), F.max(ordinal).alias("_high"), F.count_distinct(ordinal).alias("_distinct"), F.max(F.coalesce(bad, F.lit(False))).alias("_bad"))
    return stats.where("not _bad and _low = 1 and _high = n_rows and _distinct = n_rows").select(group, "n_rows")


def parent_path(path: Column) -> Column:
    """A path without its last segment; null for a single one."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))
