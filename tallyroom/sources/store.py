"""Tables that streams write batch by batch, with a manifest of what counts.

A batch is written as an attempt, a folder of its own, and counts once its commit is there: one small file, which a folder system
shows whole or not at all. Readers go by the commits, so half-written attempts, attempts of a writer that died before its
commit and files of others are never seen. A batch that is delivered again after its commit is left alone, one that is
delivered again before it becomes a new attempt.

Batches are numbered by run. A run belongs to one checkpoint, which its commits name; another checkpoint numbers its
batches from 0 again and has to be another run, so that it adds to the table and never replaces anything in it.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "run string, batch bigint, attempt string, origin string"


class OtherOrigin(ValueError):
    """A run was written from another checkpoint."""


def run_of(checkpoint: str) -> str:
    """The run of a checkpoint that has no name of its own."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """What counts in a store: a row for each batch; none where nothing was written yet."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{folder}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def write_attempt(tables: dict[str, DataFrame], folder: str, batch: int, run: str) -> str:
    """Write the tables of a batch without committing them; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/data/{run}/{batch}/{attempt}/{name}")
    return attempt


def commit(spark: SparkSession, folder: str, batch: int, run: str, attempt: str, origin: str = "") -> None:
    """Make an attempt count. The folder is named by the batch, so of two writers of one batch the second fails."""
    row = spark.createDataFrame([(run, batch, attempt, origin)], COMMIT).coalesce(1)
    row.write.mode("errorifexists").json(f"{folder}/commits/{run}/{batch}")


def is_committed(spark: SparkSession, folder: str, batch: int, run: str, origin: str = "") -> bool:
    found = commits(spark, folder).where((F.col("run") == run) & (F.col("batch") == batch)).first()
    if found and found["origin"] != origin:
        raise OtherOrigin(f"run {run} of {folder} was written from {found['origin'] or 'another place'}")
    return found is not None


def write_batch(tables: dict[str, DataFrame], folder: str, batch: int, run: str, origin: str = "") -> bool:
    """Write and commit the tables of a batch; nothing happens if the batch is committed already."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"a run is named by letters, digits, dots and dashes, not {run!r}")
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, folder, batch, run, origin):
        return False
    commit(spark, folder, batch, run, write_attempt(tables, folder, batch, run), origin)
    return True


def read_batches(spark: SparkSession, folder: str, schema: str, table: str = "rows", run: str | None = None, last: bool = False) -> DataFrame:
    """The committed rows of a table, of one run or all; with ``last`` those of a run's last batch only.

    The list of commits is read on the driver, as the list of files is by any file source.
    """
    known = commits(spark, folder)
    if run is not None:
        known = known.where(F.col("run") == run)
    rows = sorted(known.collect(), key=lambda r: (r["run"], r["batch"]))
    paths = [f"{folder}/data/{r['run']}/{r['batch']}/{r['attempt']}/{table}" for r in (rows[-1:] if last else rows)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sink(folder: str, run: str, origin: str = "", columns: list[str] | None = None):
    """``foreachBatch`` writer: all or nothing per batch, retried by restarting the query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch({"rows": batch.select(*columns) if columns else batch}, folder, batch_id, run, origin)
    return write
