"""Log segments as files."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/"
LINE_ORDER = ["file", "block", "line_no"]


def absolute_path(path: str, root: str = ROOT) -> str:
    """A relative path is taken from the file root."""
    return path if os.path.isabs(path) else os.path.join(root, path)


def land_segments(lines: DataFrame, folder: str) -> None:
    """Write lines ``(namespace, segment, value)`` in arrival order, one file per segment.

    Choose segments as a log rotation does, so that one never outgrows a task.
    """
    order = [c for c in lines.columns if c not in ("namespace", "segment", "value")]
    (lines.repartition("namespace", "segment").sortWithinPartitions("namespace", "segment", *order)
     .select("namespace", "segment", "value").write.mode("append").partitionBy("namespace", "segment").text(folder))


def with_line_order(lines: DataFrame) -> DataFrame:
    """Add each line's place in its file split to lines that carry ``file`` and ``block`` and no place."""
    return lines if "line_no" in lines.columns else lines.withColumn("line_no", F.monotonically_increasing_id())


def log_source(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Stream of landed log segments, each read once it is there. For files that still grow there is ``growing.growing_logs``."""
    reader = spark.readStream.format("text").schema("value string, namespace string, segment string")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(absolute_path(folder)).select(
        "namespace", "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))
