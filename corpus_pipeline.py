"""The corpus pipeline: quality rules, near-duplicate and repeat removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of documents.  Nulls, empty texts, repeated rows and empty
tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free, written
from lodestone.llm.decontaminate import without_contaminated
from lodestone.llm.mixing import mixed_parts
from lodestone.llm.near_dedup import without_near_copies
from lodestone.llm.quality import good_documents
from lodestone.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the models keep."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least id."""
    return without_near_copies(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller id has in a string of 50."""
    return without_repeats(docs, 50)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window of ten words."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document part of each slot, as often as it is drawn.

    text is the part's; the document's other columns (n_chars, too) are those of the
    whole document.  shard, slot and place order the parts; words is the part's size.
    Where documents has a column of such a name, an underscore follows ours."""
    own = (F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns)
    return mixed_parts(docs).select(*own, *(F.col(x).alias(free(x, docs.columns)) for x in ("shard", "slot", "place", "words")))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_to_weights),
]

#: Trained models, similarity classes and drawn blocks aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
