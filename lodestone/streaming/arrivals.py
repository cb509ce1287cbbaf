"""Extensions: files and events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import files as S

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files below a path: path, length, content."""
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path).select("path", "length", "content")


def catalog_arrivals(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Keep the table of files at `out` up to date; each batch is appended once."""

    def append(batch: DataFrame, number: int) -> None:
        S.documents(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return arriving_files(spark, path).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Events by kind and tumbling window, for rows that are at most `late` behind."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")
