"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt out by ranges of their id, so files follow each other in
ascending order and hold disjoint ranges; Spark's ORC writer cuts a file into
stripes, encodes ids by run lengths and keeps the least and greatest document
id of each stripe and row group with a Bloom filter. A reader splits files at
stripes, and a look-up by id opens only stripes whose statistics admit it.

Rows without an id come first; rows that share an id keep the order of the
input; a null text has no ids but the end id. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written
from tallyroom.llm.tokens import encoder, ended, vocabulary_path
from tallyroom.workspace import new_folder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
#: Documents whose ids are handed over at once.
ROWS = 4000
#: Where each file begins is broadcast up to so many files, 12 bytes each.
FEW_FILES = 200_000
OPTIONS = {
    "compression": "lz4", "orc.create.index": "true", "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.stripe.size": str(64 << 20),
}


def write(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, options: dict[str, str] | None = None) -> None:
    """Encode every whole text and write its ids, in ascending order of ``doc_id``, to the new folder ``path``."""
    vocabulary = vocabulary or vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, ends = ended(*coder.encode(batch.column("text")), end_id)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids.view(np.int32), pa.int32()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), pa.array(at + ends[:-1]), pa.array(np.diff(ends)),
                 lists.cast(pa.list_(pa.int32()))], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            at += int(ends[-1])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**OPTIONS | (options or {})).orc(path)


def _starts(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``part`` and ``local_start`` replaced by ``start``."""
    spark = rows.sparkSession
    totals = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    before = written(totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "starts")
    if before.count() <= FEW_FILES:
        before = F.broadcast(before)
    rest = [c for c in rows.columns if c not in ("part", "doc_id", "local_start")]
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), *rest)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids`` of the files; ``start`` counts the ids of all documents before."""
    return _starts(spark.read.schema(SCHEMA).orc(path), path)


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; statistics and Bloom filters rule out most stripes."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``doc_id, start, n_tokens, ids_crc32`` of the files: the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            names = ["part", "doc_id", "local_start", "n_tokens"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(crcs, pa.int64())], [*names, "ids_crc32"])

    rows = spark.read.schema(SCHEMA).orc(path)
    return _starts(rows.mapInArrow(crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"), path)


def op2_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-ids")
    write(documents(spark, sf_dir), path)
    return digests(spark, path)


QUERIES = {"op2_orc_token_ids": op2_orc_token_ids}
ORACLES: dict[str, str] = {}
