"""Exact deduplication by Grace hash partitioning on complete contents.

A pass over records keeps contents in an open-addressing table. A record whose
content is in the table is absorbed; a new content goes into the table while
that fits its memory, else to one of several spill files by bits of its hash.
Then the table is complete for its contents, and each spill file is passed over
likewise, with the next bits. Every pass takes contents out, so it ends, and
a content with any number of copies takes one place.

Each task reduces its own rows first, so of a group of copies one row for each task
is shuffled by the content's hash, and the same pass settles those rows.

Equal are texts that are the same after lower-casing A-Z; null counts as empty.
The row with the largest ``doc_id`` stays, one without an id only where none has
one; of rows that share it, the last in the order of the input.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyroom.llm.common import documents, written

#: Bytes of contents that a table holds.
MEMORY = 64 << 20
BITS = 4
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def normal(text: bytes | None) -> bytes:
    return (text or b"").translate(_LOWER)


class Table:
    """Open addressing with linear probing; contents are compared whole."""

    def __init__(self):
        self.mask, self.slots, self.hashes, self.contents, self.values, self.bytes = 1023, [-1] * 1024, [], [], [], 0

    def find(self, h: int, content: bytes) -> int:
        """Place of the content, or less than zero: the free slot, as -1 - slot."""
        slots, at = self.slots, h & self.mask
        while (k := slots[at]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k
            at = (at + 1) & self.mask
        return -1 - at

    def add(self, slot: int, h: int, content: bytes, value: object) -> None:
        self.slots[-1 - slot] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.bytes += len(content) + 200
        if 2 * len(self.hashes) > self.mask:
            self.mask = 4 * (self.mask + 1) - 1
            self.slots = [-1] * (self.mask + 1)
            for k, h in enumerate(self.hashes):
                at = h & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = k


def passes(records: Iterator[tuple], merge: Callable, memory: int = MEMORY, level: int = 0) -> Iterator[tuple]:
    """(hash, content, value) of each distinct content; ``merge(old, new)`` joins the values of its records."""
    table, folder, files = Table(), None, {}
    try:
        for h, content, value in records:
            at = table.find(h, content)
            if at >= 0:
                table.values[at] = merge(table.values[at], value)
            elif table.bytes <= memory:
                table.add(at, h, content, value)
            else:
                folder = folder or tempfile.mkdtemp(prefix="grace-")  # read by this task only, and deleted by it
                bucket = h >> (64 - BITS * (level % (64 // BITS) + 1)) & ((1 << BITS) - 1)
                if bucket not in files:
                    files[bucket] = open(f"{folder}/{bucket}", "wb")  # noqa: SIM115
                pickle.dump((h, content, value), files[bucket], pickle.HIGHEST_PROTOCOL)
        for f in files.values():
            f.close()
        yield from zip(table.hashes, table.contents, table.values)
        table = Table()
        for bucket in sorted(files):
            yield from passes(_spilled(f"{folder}/{bucket}"), merge, memory, level + 1)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _later(a: tuple, b: tuple) -> bool:
    """Whether key b (doc_id, row) is to stay rather than a."""
    return ((b[0] is not None, b[0] or 0), b[1]) > ((a[0] is not None, a[0] or 0), a[1])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples, bounded in rows and in bytes of binary values."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= size or weight >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def survivors(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """The rows that stay, with all their columns."""
    names = docs.columns
    # Positions, not names, so columns may be called anything; all but id and text travel in one struct.
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.lit(0).cast("long").alias("hash"), F.col("text").cast("binary").alias("text"),
                       F.struct(*[rest[f"c{i}"].alias(f"c{i}") for i, c in enumerate(names) if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]).alias("rest"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def records() -> Iterator[tuple]:
            for batch in batches:
                kinds.append(batch.schema) if not kinds else None
                for id, row, text, other in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "text", "rest"))):
                    content = normal(text)
                    yield xxhash.xxh3_64_intdigest(content), content, (id, row, text, other)

        found = passes(records(), lambda a, b: b if _later(a, b) else a, memory)
        first = next(found, None)
        if first is not None:
            def rows() -> Iterator[tuple]:
                for h, _, (id, row, text, other) in _with(first, found):
                    yield id, row, h - (1 << 63), text, other
            yield from _batches(rows(), kinds[0])

    local = rows.mapInArrow(reduce, rows.schema)
    kept = local.repartition("hash").mapInArrow(reduce, rows.schema)
    back = {c: F.col(f"rest.c{i}") for i, c in enumerate(names)}
    back |= {"doc_id": F.col("id").cast(docs.schema["doc_id"].dataType), "text": F.col("text").cast("string")}
    return kept.select(*[back[c].alias(c) for c in names])


def _with(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


_LOCAL = T.StructType([T.StructField(n, t) for n, t in (
    ("rep", T.LongType()), ("doc_id", T.LongType()), ("row", T.LongType()), ("n", T.LongType()),
    ("hash", T.LongType()), ("sha", T.StringType()), ("content", T.BinaryType()))])
_LOCAL_ARROW = pa.schema([("rep", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()),
                          ("hash", pa.int64()), ("sha", pa.string()), ("content", pa.binary())])
_GROUPS = pa.schema([("rep", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def report(docs: DataFrame, memory: int = MEMORY) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document with its class in this task, and one for each class with the content."""
        base, members = TaskContext.get().partitionId() << 33, []
        seen = iter(range(1 << 33))

        def records() -> Iterator[tuple]:
            for batch in batches:
                for id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                    content = normal(text)
                    yield xxhash.xxh3_64_intdigest(content), content, (None, id, row, 1)

        def named(value: tuple) -> int:
            rep = value[0] if value[0] is not None else base + next(seen)
            return rep

        def merge(a: tuple, b: tuple) -> tuple:
            rep = named(a)
            if a[0] is None:
                members.append((rep, a[1], a[2]))
            members.append((rep, b[1], b[2]))
            best = b if _later(a[1:3], b[1:3]) else a
            return rep, best[1], best[2], a[3] + b[3]

        def rows() -> Iterator[tuple]:
            for h, content, value in passes(records(), merge, memory):
                rep = named(value)
                if value[0] is None:
                    yield rep, value[1], value[2], None, None, None, None
                yield rep, value[1], value[2], value[3], h - (1 << 63), hashlib.sha256(content).hexdigest(), content
            for rep, id, row in members:
                yield rep, id, row, None, None, None, None

        yield from _batches(rows(), _LOCAL_ARROW)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                for rep, id, row, n, h, sha, content in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                    yield h + (1 << 63), content, ([rep], id, row, n, sha)

        def merge(a: tuple, b: tuple) -> tuple:
            a[0].extend(b[0])
            best = b if _later(a[1:3], b[1:3]) else a
            return a[0], best[1], best[2], a[3] + b[3], a[4]

        def rows() -> Iterator[tuple]:
            for _, _, (reps, id, row, n, sha) in passes(records(), merge, memory):
                for rep in reps:  # one for each task that met the content
                    yield rep, id, row, n, sha

        yield from _batches(rows(), _GROUPS)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    found = written(rows.mapInArrow(local, _LOCAL), "grace")
    groups = found.where("content is not null").repartition("hash").mapInArrow(
        settle, "rep long, keep_id long, keep_row long, group_size long, text_sha256 string")
    members = found.where("n is null").select("rep", "doc_id", "row")
    return members.join(groups, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def op4_grace_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))


QUERIES = {"op4_grace_exact_dedup": op4_grace_exact_dedup}
ORACLES = {"op4_grace_exact_dedup": """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents)
select doc_id, max(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
  doc_id = max(doc_id) over (partition by x) as kept, sha256(x) as text_sha256
from t"""}
