"""Rows out of texts: lines, islands, character statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Lines of at least `least` characters, tested before they are trimmed: key, line_no, line."""
    parts = df.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "_line")).where(F.length("_line") >= least)
    return parts.select(key, (F.col("_pos") + 1).alias("line_no"), F.trim("_line").alias("line"))


def islands(df: DataFrame, key: str, order: list[str], good: Column, least: int, *aggregates: Column) -> DataFrame:
    """Runs of consecutive good rows of a key with at least `least` rows.

    Runs are numbered before short ones go, so the numbers have holes."""
    own = df.withColumn("_good", F.coalesce(good, F.lit(False)))
    run = F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    numbered = own.withColumn("island", run).where("_good")
    return numbered.groupBy(key, "island").agg(F.count("*").alias("n_rows"), *aggregates).where(F.col("n_rows") >= least)


def char_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """Shannon entropy of each text's characters in bits: key, entropy; texts without characters have no row.

    Counted within the row, over its sorted characters: no shuffle, linear but for the sort."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    step = lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"), F.when(a["c"] == c, a["s"]).otherwise(a["s"] + weight(a["n"])).alias("s"))
    size = F.size(chars).cast("double")
    total = F.aggregate(chars, start, step, lambda a: a["s"] + weight(a["n"]))
    return df.where(F.length(text) > 0).select(key, (F.log2(size) - total / size).alias("entropy"))


def object_tokens(df: DataFrame, key: str, text: str, kind_of, per_name: int, per_kind: int) -> DataFrame:
    """Tokens of a text that name an object: key, pos, token, kind; at most `per_name` of a name and then `per_kind` of a kind, the first ones."""
    tokens = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_.@-]+)"), 1)
    own = df.select(key, F.posexplode(tokens).alias("at", "token")).select(key, (F.col("at") + 1).alias("pos"), "token", kind_of(F.col("token")).alias("kind")).where("kind is not null")
    few = own.withColumn("r", F.row_number().over(Window.partitionBy(key, "token").orderBy("pos"))).where(F.col("r") <= per_name)
    return few.withColumn("r", F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos"))).where(F.col("r") <= per_kind).drop("r")


def shortened(text: Column, most: int) -> Column:
    """A text of at most `most` characters; a longer one ends in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def workbook_links(df: DataFrame, key: str, text: str) -> DataFrame:
    """The first run between NULs that names an external workbook in brackets: key, reference, workbook."""
    runs = F.filter(F.split(text, "\x00"), lambda x: x.rlike(r"(?i)\[[^\[\]]*\.xlsx\]"))
    own = df.select(key, F.get(runs, F.lit(0)).alias("run")).where("run is not null")
    return own.select(key, F.regexp_replace("run", "^\n", "").alias("reference"), F.regexp_extract("run", r"(?i)\[([^\[\]]*\.xlsx)\]", 1).alias("workbook"))


def leaf_fields(df: DataFrame, key: str, markup: str, tags: list[str]) -> DataFrame:
    """Texts of leaf elements with one of the tags: key, tag, value."""
    found = F.regexp_extract_all(markup, F.lit(r"(<[a-z]+(?:\s[^<>]*)?>[^<>]*</)"), 1)
    own = df.select(key, F.explode(found).alias("leaf")).select(key, F.regexp_extract("leaf", "^<([a-z]+)", 1).alias("tag"), F.trim(F.regexp_extract("leaf", ">([^<>]*)</$", 1)).alias("value"))
    return own.where(F.col("tag").isin(tags))


def report_fields(df: DataFrame, key: str, markup: str) -> DataFrame:
    """Of well-formed report markup: label, n, mean, and how many ID pairs it has with the last one's value.

    Markup that doesn't parse has nulls, no error."""
    good = F.when(F.col(markup).rlike(r"(?s)^\s*<([A-Za-z]+)\b.*</\1>\s*$"), F.col(markup))
    at = lambda path: F.nullif(F.xpath_string(good, F.lit(path)), F.lit(""))
    return df.select(key, at("/*/@Label").alias("label"), at("/*/N").try_cast("int").alias("n"), at("/*/Mean").try_cast("double").alias("mean"), F.xpath_int(good, F.lit("count(/*/Pair[@ID])")).alias("n_pairs"), at("/*/Pair[@ID][last()]").alias("last_pair"))
