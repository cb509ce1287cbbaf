"""The commands as functions that return DataFrames: inspect, catalog, get, extract, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import compare as C
from lodestone.sources import files as S


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: what it is, what is in it, and how well it is supported."""
    files = S.binary_files(spark, path)
    docs = S.documents(files)
    found = S.legacy_elements(files).groupBy("path").agg(F.count_if(F.col("kind") == "dataset").alias("n_datasets"), F.count_if(F.col("kind") == "object").alias("n_objects"), F.max(F.when(F.col("kind") == "truncation", F.col("start_offset"))).alias("truncated_at"))
    pictures = S.images(files).groupBy("path").agg(F.count("*").alias("n_images"))
    out = docs.join(found, "path", "left").join(pictures, "path", "left").fillna(0, ["n_datasets", "n_objects", "n_images"])
    support = F.when(F.col("truncated_at").isNotNull(), "failed").when(F.col("n_datasets") > 0, "parser").when(F.col("detected_type").isin("legacy_project", "unicode_project"), "partial").otherwise("heuristic")
    return out.withColumn("support", support)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """All items of all files with stable ids, parser rows before heuristic ones, in catalog order."""
    files = S.binary_files(spark, path)
    docs = S.documents(files).select("path", "sha256")
    parts = [
        S.legacy_elements(files).where("kind = 'dataset'").select("path", F.lit("worksheet_column").alias("kind"), "name", F.col("start_offset").alias("offset"), (F.col("end_offset") - F.col("start_offset")).alias("length"), F.lit(False).alias("heuristic")),
        S.unicode_elements(files).where("kind in ('column', 'raw_region', 'decoded_region')").select("path", F.when(F.col("kind") == "column", "worksheet_column").otherwise(F.col("kind")).alias("kind"), "name", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), F.lit(False).alias("heuristic")),
        S.images(files).where("valid").select("path", F.concat(F.lit("image_"), "kind").alias("kind"), F.concat("kind", F.lit("_"), "offset").alias("name"), "offset", "length", F.lit(False).alias("heuristic")),
        S.containers(files).select("path", "kind", F.concat("kind", F.lit("_"), "offset").alias("name"), "offset", "length", F.lit(True).alias("heuristic")),
    ]
    items = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).join(docs, "path")
    same = Window.partitionBy("sha256", "kind", "name", "offset", "length").orderBy("path")
    items = items.withColumn("occurrence", F.row_number().over(same))
    identity = F.concat(F.lit("item:v1:"), F.sha2(F.concat_ws("|", "sha256", "name", "kind", "offset", "length", "occurrence").cast("binary"), 256))
    return items.withColumn("id", identity)


def get(spark: SparkSession, path: str, item: str) -> DataFrame:
    """An item's catalog row with its exact bytes."""
    row = catalog(spark, path).where(F.col("id") == item)
    return row.join(S.binary_files(spark, path).select("path", "content"), "path").withColumn("bytes", F.expr("substring(content, offset + 1, length)")).drop("content")


def extract(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write the tables below `out` (which must not exist) and return the manifest: name, rows."""
    files = S.binary_files(spark, path)
    tables = {"files": S.documents(files), "catalog": catalog(spark, path), "elements": S.legacy_elements(files), "cells": S.legacy_cells(files).unionByName(S.unicode_cells(files).withColumnRenamed("ordinal", "dataset")), "storage_regions": S.storage_regions(files), "parameters": S.parameters(files), "strings": S.strings(files), "numeric_tables": S.numeric_tables(files), "images": S.images(files)}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{out}/{name}")
    counts = [spark.read.parquet(f"{out}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name in sorted(tables)]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    return manifest


def compare(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Differences of two extractions' catalogs and cells: table, key, reason."""
    a, b = spark.read.parquet(f"{left}/catalog"), spark.read.parquet(f"{right}/catalog")
    items = C.multiset_diff(a, b, ["kind", "name", "offset", "length"]).select(F.lit("catalog").alias("table"), F.concat_ws("/", "kind", "name").alias("key"), F.when(F.col("left_count") > F.col("right_count"), "missing_right").otherwise("missing_left").alias("reason"))
    x, y = (spark.read.parquet(f"{p}/cells") for p in (left, right))
    cells = C.cell_differences(x, y, ["dataset", "name", "row"], "f64").select(F.lit("cells").alias("table"), F.concat_ws("/", "name", "row").alias("key"), "reason")
    return items.unionByName(cells)


def to_csv(df: DataFrame, out: str, separator: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", separator).csv(out)


def packed(df: DataFrame, values: str) -> DataFrame:
    """An array column as one text, joined by semicolons; those inside become %3B."""
    return df.withColumn(values, F.concat_ws(";", F.transform(values, lambda v: F.replace(v, F.lit(";"), F.lit("%3B")))))


def walk(spark: SparkSession, path: str) -> DataFrame:
    """Elements of legacy and unicode projects in order: path, kind, name, start, end."""
    files = S.binary_files(spark, path)
    legacy = S.legacy_elements(files).select("path", "kind", "name", F.col("start_offset").alias("start"), F.col("end_offset").alias("end"))
    return legacy.unionByName(S.unicode_elements(files)).orderBy("path", "start", "end", "kind", "name")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The exact bytes of every item that has its own, as rows instead of files: path, artifact (a name with offset and length), bytes.

    A table of them is written like any other, so no executor writes to its own disk."""
    items = catalog(spark, path).select("path", "id", "kind", "offset", "length")
    extension = F.when(F.startswith("kind", F.lit("image_")), F.substring("kind", 7, 10)).when(F.col("kind").isin("raw_region", "decoded_region"), "xml").otherwise("bin")
    name = F.concat("kind", F.lit("_"), F.col("offset"), F.lit("_"), F.col("length"), F.lit("."), extension)
    own = items.join(S.binary_files(spark, path).select("path", "content"), "path")
    return own.select("path", "id", name.alias("artifact"), F.expr("substring(content, offset + 1, length)").alias("bytes"))


def to_jsonl(df: DataFrame, out: str) -> None:
    """One JSON record a row; the header record of a table is reshape.jsonl's."""
    df.write.mode("errorifexists").option("ignoreNullFields", "true").json(out)


#: Rows that a sheet of a workbook can hold.
SHEET_ROWS = 1_048_576


def to_xlsx(df: DataFrame, out: str) -> None:
    """One sheet with a header row, row by row through the driver; needs a library that may be absent, and refuses what a sheet can't hold."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise ModuleNotFoundError("writing workbooks needs openpyxl") from e
    book = Workbook(write_only=True)
    sheet = book.create_sheet()
    sheet.append(df.columns)
    for n, row in enumerate(df.toLocalIterator()):
        if n + 1 >= SHEET_ROWS:
            raise ValueError("more rows than a sheet can hold")
        sheet.append(list(row))
    book.save(out)
