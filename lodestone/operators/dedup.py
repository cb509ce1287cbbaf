"""Content dedup, identities and capped selections.

All of them aggregate before they join or rank, so that a group that holds a
large share of the rows is reduced where its rows are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_dedup(df: DataFrame, group: list[str], digest: Column, order: list[str]) -> DataFrame:
    """Every row with its content's kept row: digest, kept (struct of `order`), is_alias, n_copies.

    A content is a group and a digest; its first row by `order` is kept and the others are aliases of it."""
    keyed = df.withColumn("digest", digest)
    keys = [*group, "digest"]
    first = keyed.groupBy(*[F.col(k).alias("_k_" + k) for k in keys]).agg(F.min(F.struct(*order)).alias("kept"), F.count("*").alias("n_copies"))
    joined = keyed.join(first, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys])
    return joined.select(*keyed.columns, "kept", "n_copies", (~F.col("kept").eqNullSafe(F.struct(*order))).alias("is_alias"))


def occurrence(df: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Rows numbered within equal keys, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def identity(*parts: str) -> Column:
    """A stable item id: SHA-256 of the parts, joined by a bar; null parts are left out."""
    return F.concat(F.lit("item:v1:"), F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]).cast("binary"), 256))


def cap_per_kind(df: DataFrame, kind: str, order: list[str], limit: int, exempt: Column | None = None) -> DataFrame:
    """At most `limit` rows of each kind, the first by `order`; exempt rows are neither counted nor dropped."""
    exempt = F.lit(False) if exempt is None else F.coalesce(exempt, F.lit(False))
    free = df.where(exempt)
    ranked = df.where(~exempt).withColumn("_rank", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_rank") <= limit).drop("_rank")
    return ranked.unionByName(free)


def cap_with_slots(df: DataFrame, name: str, confirmed: Column, order: list[str], limit: int) -> DataFrame:
    """At most `limit` rows of each name; rows that aren't confirmed only get the slots that confirmed rows leave."""
    ranked = df.withColumn("_confirmed", F.coalesce(confirmed, F.lit(False)))
    by = Window.partitionBy(name).orderBy(F.col("_confirmed").desc(), *order)
    return ranked.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= limit).drop("_rank", "_confirmed")


def unique_suffix(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Names made unique: the second of a name gets __2, and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_n", n).withColumn(out, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("__"), F.col("_n")))).drop("_n")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first by `order` (which must be orderable structs' fields): a partial aggregate, no window."""
    columns = df.columns
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row"))
    return packed.select("_row.*")


def union_first_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the first frame that has a key gives its row."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return first_by(out, keys, [F.col("_priority")]).drop("_priority")
