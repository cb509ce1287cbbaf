"""Tables written in the folder that driver and executors share, for results that are read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For tables of a session: on a local disk Hadoop starts a process for each file and folder it makes, and checksums are
#: files, too.  What an executor starts shows all its memory as its own for a moment.
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named:
            named = tempfile.mkdtemp(prefix="lodestone-checkpoints-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def _delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as a table in the shared folder, deleted when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}"
    df.write.options(**SCRATCH).parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, parts: int, label: str) -> DataFrame:
    """Like written(), with the rows of a key in one of so many parts: to group by it takes no exchange, however often.

    The catalog has its name only while it is made."""
    spark, name = df.sparkSession, f"lodestone_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(name)
    _delete_at_end(spark, path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # not its files, which lie outside the warehouse
    return table
