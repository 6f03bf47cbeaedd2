"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Documents are cut freely: full windows first, and what is left over into pieces of a
quarter of a window at most. Pieces of one task are gathered up to a number
of windows and divided among them by differencing: every piece starts as a partial
partition of its own, and the two partitions of largest imbalance are merged, the
fullest windows of one with the emptiest of the other, until one is left, whose
windows are nearly equal. If one exceeds the capacity, there is a window more and
the pieces are divided again. So all windows are nearly full, and no document moves
from the task that read it.

A null or empty text is its end id alone. Rows that share an id are documents of their own.
Windows are padded to the capacity but for those that hold a power of two.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written
from tallyroom.llm.tokens import encoder, ended, vocabulary_path

WINDOW = 1024
#: Windows that are divided together; the cost of a merge grows with them, what one window more loses shrinks.
TOGETHER = 192
PIECES = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("local", pa.int64()), ("offset", pa.int64())])


def divide(sizes: list[int], k: int) -> list[int]:
    """A window of 0 to k - 1 for each size, by differencing."""
    if k == 1:
        return [0] * len(sizes)
    heap, nodes = [], []  # a node: (left, right, order) of a merge
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums))
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heap[0]
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), n + len(nodes), sums))
        nodes.append((a, b, order))
    where, todo = [0] * n, [(heap[0][1], np.arange(k))]
    while todo:
        node, window = todo.pop()
        if node < n:
            where[node] = int(window[0])
            continue
        a, b, order = nodes[node - n]
        left, right = np.empty(k, np.int64), np.empty(k, np.int64)
        left[order], right[k - 1 - order] = window, window
        todo += [(a, left), (b, right)]
    return where


def windows(sizes: list[int], capacity: int) -> list[int]:
    """A window for each size with no sum above the capacity."""
    k = -(-sum(sizes) // capacity)
    while True:
        where = divide(sizes, k)
        most = int(np.bincount(where, sizes, minlength=k).max())
        if most <= capacity:
            return where
        k += max(1, (most - capacity) * k // (2 * capacity))


def pack(docs: DataFrame, capacity: int = WINDOW, end_id: int = 0, vocabulary: str | None = None, together: int = TOGETHER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary, largest = vocabulary or vocabulary_path(), max(1, capacity // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, n, held, weight = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], 0

        def settle(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal n
            where = windows([p[2] for p in pieces], capacity)
            filled: dict[int, int] = {}
            names = {w: n + i for i, w in enumerate(dict.fromkeys(where))}
            n += len(names)
            for p, w in zip(pieces, where):
                at = filled.get(w, 0)
                yield (part, *p, names[w], at)
                filled[w] = at + p[2]

        def rows() -> Iterator[list[tuple]]:
            nonlocal n, held, weight
            for batch in batches:
                ids, ends = ended(*coder.encode(batch.column("text")), end_id)
                raw, out = memoryview(ids.tobytes()), []
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    size = b - a
                    full = size - size % capacity
                    cuts = [*range(0, full, capacity), *range(full, size, largest), size]
                    for s, e in zip(cuts, cuts[1:]):
                        piece = (doc, s, e - s, zlib.crc32(raw[4 * (a + s) : 4 * (a + e)]), size)
                        if e - s == capacity:
                            out.append((part, *piece, n, 0))
                            n += 1
                        else:
                            held.append(piece)
                            weight += e - s
                    if weight >= together * capacity:
                        out += settle(held)
                        held, weight = [], 0
                yield out
            if held:
                yield list(settle(held))

        for some in rows():
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), PIECES)], schema=PIECES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = written(rows.mapInArrow(cut, "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long"), "pieces")
    counts = found.groupBy("part").agg((F.max("local") + 1).alias("n"))  # a row for each task
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return found.join(before, "part").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("local")).alias("sequence_id"), "offset")


def op8_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op8_karmarkar_karp_packing": op8_karmarkar_karp_packing}
ORACLES: dict[str, str] = {}
