"""Reading tables by folder and name; column pruning and filters reach the files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, split_column: str | None = None,
              lower: int = 0, upper: int = 0, splits: int = 1, **options: str) -> DataFrame:
    """A database table; with ``split_column`` the read is split over tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column:
        reader = reader.options(partitionColumn=split_column, lowerBound=lower,
                                upperBound=upper, numPartitions=splits)
    return reader.load()


def fixed_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed values, kept in the plan rather than shipped from Python."""
    values = F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(values))


def scan_all(df: DataFrame) -> DataFrame:
    return df.select("*")


def scan_filter_eq(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def update_by_id(rows: DataFrame, changes: DataFrame, key: str, columns: list[str],
                 overwrite_nulls: bool = False) -> DataFrame:
    """Rows with ``columns`` replaced by those of the change with the same id."""
    named = changes.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed"))

    def value(c: str) -> Column:
        if overwrite_nulls:
            return F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.coalesce(F.col(f"_new_{c}"), F.col(c))

    joined = rows.join(named, key, "left")
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in rows.columns])
