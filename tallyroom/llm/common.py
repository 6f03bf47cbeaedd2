"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.workspace import new_folder

#: A word is a run of other characters than space, tab, newline, vertical tab, form feed and return.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """The rows from a table in the shared folder: lineage ends there and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(columns: list[str]) -> Column:
    """All columns in one struct, by position, so they may be called anything."""
    return F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_row")


def unpacked(columns: list[str], of: list[str] | None = None) -> list[Column]:
    """The columns that ``packed`` took, or some of them."""
    return [F.col(f"_row.c{columns.index(c)}").alias(c) for c in (columns if of is None else of)]


def numbered(docs: DataFrame) -> DataFrame:
    """``_row, _id``: each row with an id of its own, given once and written. An id that is made anew by each read may name
    another row the next time, as it depends on how files are cut, and that on the cores that are there."""
    return written(docs.select(packed(docs.columns), F.monotonically_increasing_id().alias("_id")), "numbered")


def words(text: Column) -> Column:
    """Words of a text, none for null or white space only. Only the first and last part of a split can be empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
