"""A corpus pipeline: rules, exact and near copies, the mix, packing.

Each stage takes what its predecessor kept and reads only that and, for labels, the given folder. Rows that repeat an id are
documents of their own; a null text is an empty text; further columns of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm import grace, mixing, packing, quality, simhash
from tallyroom.llm.common import numbered, unpacked
from tallyroom.workspace import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.survivors(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return grace.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id; of rows that share it, the first."""
    names, table = docs.columns, numbered(docs)
    groups = simhash.near_duplicates(table.select("_id", *unpacked(names, ["doc_id", "text"])), row=F.col("_id"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"))
    return table.join(first.select(F.col("m.row").alias("_id")), "_id").select(*unpacked(names))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing", mix), ("packing", pack),
]
#: SQL expresses neither the rounding of the mix nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
