"""Tables that are updated by key, without a table format: rows lie in buckets by key, and a change writes new copies of the
buckets it touches.

A version of the table is a batch of a committed store (``store``): the new copies and an index that points at the newest copy of every
bucket. Its commit is the swap; until then readers see the version before, and a writer that dies leaves it in place.
Of two writers who start from one version the second one's commit fails, and it may begin again from the new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.sources import store
from tallyroom.sources.tables import update_by_id

INDEX = "bucket int, path string, buckets int"
RUN = "table"
#: A table begins with a bucket for so many rows, and with so many buckets at least and at most.
BUCKET_ROWS, FEWEST, MOST = 100_000, 8, 4096


class Conflict(RuntimeError):
    """Another writer was faster."""


def _index(spark: SparkSession, folder: str) -> tuple[int, dict[int, str], int]:
    """The version, the path of each bucket and the number of buckets."""
    newest = store.commits(spark, folder).agg(F.max("batch")).first()[0]
    rows = store.read_batches(spark, folder, INDEX, "index", RUN, last=True).collect()  # a row for each bucket
    return (-1 if newest is None else newest), {r["bucket"]: r["path"] for r in rows}, (rows[0]["buckets"] if rows else FEWEST)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest version."""
    _, paths, _ = _index(spark, folder)
    return spark.read.schema(schema).parquet(*paths.values()) if paths else spark.createDataFrame([], schema)


def _swap(rows: DataFrame, folder: str, key: str, version: int, paths: dict[int, str], buckets: int, touched: list[int]) -> None:
    spark = rows.sparkSession
    attempt = store.write_attempt({}, folder, version + 1, RUN)
    root = f"{folder}/data/{RUN}/{version + 1}/{attempt}"
    rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/rows")
    paths = paths | {k: f"{root}/rows/_bucket={k}" for k in touched}
    spark.createDataFrame([(k, p, buckets) for k, p in sorted(paths.items())], INDEX).coalesce(1).write.parquet(f"{root}/index")
    try:
        store.commit(spark, folder, version + 1, RUN, attempt)
    except Exception as e:
        raise Conflict(f"version {version + 1} of {folder} was written by another") from e


def _touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect())  # at most the number of buckets


def insert(rows: DataFrame, folder: str, key: str, schema: str, buckets: int | None = None) -> None:
    """Add rows; columns that ``rows`` lacks are null. Keys are taken to be new; ``buckets`` counts for the first rows only,
    which decide it by their number without it."""
    spark = rows.sparkSession
    version, paths, known = _index(spark, folder)
    if not paths:
        known = buckets or min(MOST, max(FEWEST, rows.count() // BUCKET_ROWS))
    empty = spark.createDataFrame([], schema)
    new = empty.unionByName(rows, allowMissingColumns=True)
    touched = _touched(new, key, known)
    old = [paths[k] for k in touched if k in paths]
    if old:
        new = spark.read.schema(schema).parquet(*old).unionByName(new)
    if touched:
        _swap(new, folder, key, version, paths, known, touched)


def update(changes: DataFrame, folder: str, key: str, schema: str, columns: list[str], overwrite_nulls: bool = False) -> None:
    """Set ``columns`` of the rows whose keys ``changes`` has, once each; other keys change nothing."""
    spark = changes.sparkSession
    version, paths, buckets = _index(spark, folder)
    touched = [k for k in _touched(changes, key, buckets) if k in paths]
    if touched:
        rows = spark.read.schema(schema).parquet(*[paths[k] for k in touched])
        _swap(update_by_id(rows, changes, key, columns, overwrite_nulls), folder, key, version, paths, buckets, touched)
