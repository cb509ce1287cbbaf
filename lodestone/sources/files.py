"""Binary files as tables, and the scans over them.

Each scan is one pass over a table (path, content), in Arrow batches, by the
plain functions of :mod:`lodestone.sources.scans` and
:mod:`lodestone.sources.legacy`.  Files are read by Spark's own source, so any
store that it can read will do."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codecs, legacy, payloads, scans, unicode


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for a context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(root):
            for name in (n for n in names if n.endswith(".py")):
                z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def binary_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modified, length, content of each file below a path; Spark's source has no row for an empty file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length", "content")


def documents(files: DataFrame) -> DataFrame:
    """A row for each file: path, length, sha256, detected_type, confidence, reason."""
    kind, confidence = F.lit("unknown"), F.lit(0.05)
    for magic, name, sure in reversed(scans.MAGIC):
        hit = F.substring("content", 1, len(magic)) == F.lit(magic)
        kind, confidence = F.when(hit, name).otherwise(kind), F.when(hit, sure).otherwise(confidence)
    return files.select("path", F.col("length"), F.sha2("content", 256).alias("sha256"), kind.alias("detected_type"), confidence.alias("confidence"), F.when(kind == "unknown", "no-match").otherwise("magic").alias("reason"))


def byte_range(content: Column, offset: int, length: int) -> Column:
    """Exact bytes of a range; a range outside the content is an error."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length are at least 0")
    return F.when(F.octet_length(content) >= offset + length, F.substring(content, offset + 1, length)).otherwise(F.raise_error(F.lit("the range runs past the end")).cast("binary"))


def scan(files: DataFrame, schema: str, rows: Callable[[bytes], Iterator[tuple]], key: str = "path") -> DataFrame:
    """Rows that a function makes of each file's bytes, with the file's key: one Arrow pass, a file at a time."""
    ship(files.sparkSession)
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}
    fields = [x.strip().split(" ", 1) for x in schema.split(",")]
    key_type = dict(files.dtypes)[key]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                found = iter(rows(raw) if raw is not None else ())
                while part := list(islice(found, 50_000)):
                    keys = batch.column(0).take(pa.array([i] * len(part), pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[k] for r in part], kinds[t]) for k, (_, t) in enumerate(fields))], names=[key, *(n for n, _ in fields)])

    return files.select(key, F.col("content")).mapInArrow(run, f"{key} {key_type}, {schema}")


def strings(files: DataFrame, least: int = 4, key: str = "path") -> DataFrame:
    """Runs of printable ASCII with byte offsets."""
    return scan(files, "offset bigint, text string", lambda b: scans.string_spans(b, least), key)


def numeric_tables(files: DataFrame, min_rows: int = 5, min_columns: int = 2, key: str = "path") -> DataFrame:
    return scan(files, "table_id int, row_in_table int, offset bigint, values array<string>", lambda b: scans.numeric_tables(b, min_rows, min_columns), key)


def images(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "kind string, offset bigint, length bigint, valid boolean", scans.images, key)


def containers(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "kind string, offset bigint, length bigint, confidence double", scans.containers, key)


def tagged_strings(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "offset bigint, length int, tag int, value string", scans.tagged_strings, key)


def tagged_scalars(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "offset bigint, field int, size int, value binary", scans.tagged_scalars, key)


def legacy_elements(files: DataFrame, key: str = "path") -> DataFrame:
    """Framed objects of legacy projects; a cut file has a row of kind truncation where its evidence is."""

    def rows(data: bytes):
        names = ("kind", "name", "start", "end", "total_rows", "value_size", "data_type", "data_offset", "data_size")
        for e in legacy.elements(data):
            yield tuple(e.get(n) for n in names)
        at = legacy.truncated_at(data)
        if at is not None:
            yield ("truncation", "", at, len(data), None, None, None, None, None)

    return scan(files, "kind string, name string, start_offset bigint, end_offset bigint, total_rows bigint, value_size int, data_type int, data_offset bigint, data_size bigint", rows, key)


def legacy_cells(files: DataFrame, key: str = "path") -> DataFrame:
    """Stored values in long form; a missing cell has its kind and nulls."""
    return scan(files, "dataset int, name string, row bigint, kind string, f64 double, i64 bigint, text string", legacy.cells, key)


def transcoded(df: DataFrame, column: str, out: str, function: Callable[[bytes], bytes]) -> DataFrame:
    """`df` with a binary column made of another by a codec, in Arrow batches."""
    ship(df.sparkSession)
    schema = df.withColumn(out, F.lit(None).cast("binary")).schema
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            made = pa.array([None if x is None else function(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)


def item_id(digest: str, path: str, kind: str, offset: int, length: int, occurrence: int = 1) -> str:
    """A catalog id: order of discovery doesn't matter, content does."""
    text = "|".join(map(str, (digest, path, kind, offset, length, occurrence)))
    return "item:v1:" + hashlib.sha256(text.encode()).hexdigest()


def lz4_blocks(files: DataFrame, key: str = "path") -> DataFrame:
    """Regions of a little-endian declared size and an LZ4 block, at markers: start, end, payload."""

    def rows(data: bytes):
        at = data.find(b"<OriginStorage")
        while at >= 0:
            start, size = at - 2, int.from_bytes(data[at - 6 : at - 2], "little") if at >= 6 else 0
            if 0 < size <= 1 << 28:
                try:
                    payload, used = codecs.lz4_decode(data[start:], size)
                    yield start, start + used, payload
                except codecs.CodecError:
                    pass
            at = data.find(b"<OriginStorage", at + 1)

    return scan(files, "start bigint, end bigint, payload binary", rows, key)


def unicode_columns(files: DataFrame, key: str = "path") -> DataFrame:
    """Stored columns of unicode projects, with what their payloads decode to."""
    return scan(files, "ordinal int, name string, start bigint, end bigint, payload bigint, size bigint, encoding string, n_rows bigint, n_missing bigint, value_type string", unicode.column_rows, key)


def unicode_cells(files: DataFrame, key: str = "path") -> DataFrame:
    """Stored values of unicode projects in long form."""
    return scan(files, "ordinal int, name string, row bigint, kind string, f64 double, i64 bigint, text string", unicode.cells, key)


def unicode_elements(files: DataFrame, key: str = "path") -> DataFrame:
    """The walk over unicode projects: start, end, kind, name."""
    return scan(files, "start bigint, end bigint, kind string, name string", unicode.walk, key)


def storage_regions(files: DataFrame, key: str = "path") -> DataFrame:
    """Storage elements of unicode projects as text, plain and decoded: start, end, source, text."""

    def rows(data: bytes):
        packed = list(unicode.decoded_regions(data))
        yield from ((a, b, "decoded", p.decode("utf-8", "replace")) for a, b, p in packed)
        yield from ((a, b, "raw", data[a:b].decode("utf-8", "replace")) for a, b in unicode.raw_regions(data) if not any(x <= a < y for x, y, _ in packed))

    return scan(files, "start bigint, end bigint, source string, text string", rows, key)


def parameters(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "name string, value double, offset bigint, length bigint", unicode.parameters, key)


def length_blocks(files: DataFrame, key: str = "path") -> DataFrame:
    return scan(files, "start bigint, end bigint, payload binary", unicode.length_blocks, key)


def payload_families(df: DataFrame, key: str = "path") -> DataFrame:
    """The family of each payload (column content) and how many records it has."""
    return scan(df, "family string, n_records int", lambda b: [payloads.family(b)], key)


def function_records(df: DataFrame, key: str = "path") -> DataFrame:
    """What the headers (column content) of functions say: type, points, first and last argument."""
    return scan(df, "type string, points bigint, first string, last string", lambda b: [x for x in (legacy.function_record(b),) if x], key)
