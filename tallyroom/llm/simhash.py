"""Near-duplicates by SimHash with a segment-popcount embedding.

A fingerprint has 64 bits, each set if it is set in over half of the hashes of the text's
shingles. It is embedded by the number of set bits in each of its 32 segments of two bits.
The Manhattan distance of two embeddings is at most the number of bits that differ, so
fingerprints within 3 bits lie within Manhattan distance 3, and within distance 1 in one of the
halves of 16 segments. A range join on the grid of half embeddings finds those: each
fingerprint stands in its own cell and visits the cells one step up in one segment, so of two
fingerprints one meets the other. Whole embeddings and then the fingerprints
themselves are compared exactly.

Only distinct fingerprints are joined, so copies cost nothing. A cell with more of them than a
block holds is dealt to blocks, and every pair of blocks is compared by itself; what
comes out of a comparison is a spanning forest of the links found, not all pairs.

A null text, like one without words, has fingerprint zero and is linked like any other. Rows that share an id
are documents of their own with one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written
from tallyroom.llm.components import components

SHINGLE, BITS = 3, 3
#: Fingerprints of a cell that are compared at once.
BLOCK = 2048
#: Links held before they are reduced to a forest.
HELD = 200_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: For each byte value its eight bits, the lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, 0 if it has no words."""
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    hashed = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [hashed(b" ".join(words), 42)]
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = (sizes + 1).cumsum() - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        hashes = [hashed(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    set_in = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: Column | None = None) -> DataFrame:
    """``doc_id, row, fp`` with the fingerprint as a signed long; ``row`` tells rows of one id apart and is any number without it."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(fps.view(np.int64))], ["doc_id", "row", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(marked, "doc_id long, row long, fp long")


def embedding(fp: Column) -> Column:
    """Counts of set bits of the 32 segments, two bits each: 01 if its two bits differ, 10 if both are set."""
    low, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_bit).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1))


def cells(distinct: DataFrame) -> DataFrame:
    """``half, cell, home, fp``: the cell of each half embedding and, as a visitor, those with one more in a segment."""
    x = distinct.select("fp", embedding(F.col("fp")).alias("e"))
    halves = x.select("fp", F.posexplode(F.array(
        F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("e", 32))).alias("half", "own"))
    steps = F.array(*[F.lit(1 << 2 * k).cast("long") for k in range(16)])
    # A count of two is the most a segment has.
    up = F.transform(F.filter(steps, lambda s: F.col("own").bitwiseAND(s * 2) == 0), lambda s: F.col("own") + s)
    return halves.select("half", F.explode(F.concat(F.array("own"), up)).alias("cell"), "own", "fp").select(
        "half", "cell", (F.col("cell") == F.col("own")).alias("home"), "fp")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node with the smallest of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def links(distinct: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """``a, b``: links of distinct fingerprints ``fp`` that span the components of those within ``bits`` (at most 3)."""
    if not 0 <= bits <= 3:
        raise ValueError("half embeddings one step apart find up to 3 bits")
    # Cells where someone is at home and someone else there, with their size.
    found = written(cells(distinct), "cells")
    full = found.groupBy("half", "cell").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("n > 1 and any")
    sized = found.join(full.select("half", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["half", "cell"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Block i meets every block: the pair is named by the smaller and the larger.
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "half", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "home", "fp")
    keys = ["half", "cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count = [], 0

        def emit() -> pa.RecordBatch:
            a, b = forest(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for table, final in _whole_groups(batches, keys):
            a, b = _within(table, bits)
            if len(a):
                kept.append((a, b))
                count += len(a)
            if count >= HELD or final and count:
                yield emit()
                kept, count = [], 0

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "side", "fp").mapInArrow(compare, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Columns of sorted rows so that no group is cut; a group is no larger than two blocks."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        rest = new if rest is None else {c: np.concatenate([rest[c], new[c]]) for c in new}
        n = len(rest["fp"])
        if not n:
            continue
        same = np.ones(n, bool)
        for k in keys:
            same &= rest[k] == rest[k][-1]
        cut = n - int(same[::-1].argmin()) if not same.all() else 0
        if cut:
            yield {c: v[:cut] for c, v in rest.items()}, False
            rest = {c: v[cut:] for c, v in rest.items()}
    yield rest if rest is not None else {c: np.zeros(0, np.int64) for c in [*keys, "side", "home", "fp"]}, True


def _within(t: dict[str, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of sorted rows: all pairs of a block with itself, and of two blocks across."""
    n = len(t["fp"])
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if n < 2:
        return a[0], b[0]
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([t[k][1:] != t[k][:-1] for k in ("half", "cell", "i", "j")])
    begins = np.flatnonzero(new)
    group = new.cumsum() - 1
    left = np.append(begins[1:], n)[group] - np.arange(n)  # rows of the group from this one on
    fp, home = t["fp"].view(np.uint64), t["home"].astype(bool)
    e = fp - (fp >> np.uint64(1) & np.uint64(0x5555555555555555))
    across = t["i"] != t["j"]
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):  # every row against the one ``step`` after it, as long as its group goes
        x, y = rows, rows + step
        x, y = (z[(home[x] | home[y]) & ~(across[x] & (t["side"][x] == t["side"][y]))] for z in (x, y))
        near = _manhattan(e[x], e[y]) <= bits
        x, y = x[near], y[near]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= bits
        x, y = x[near], y[near]
        if len(x):
            a.append(t["fp"][x])
            b.append(t["fp"][y])
            if sum(map(len, a)) > HELD:
                u, v = forest(np.concatenate(a), np.concatenate(b))
                a, b = [u], [v]
        step += 1
        rows = rows[left[rows] > step]
    return np.concatenate(a), np.concatenate(b)


def _manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of embeddings. Counts are 0, 1 or 2: |p - q| is 2 where one is 2 and the other 0, else whether they differ."""
    low = np.uint64(0x5555555555555555)
    d = x ^ y
    one, two = d & low, d >> np.uint64(1) & low
    # d = 01: 0 with 1, one apart; 10: 0 with 2, two apart; 11: 1 with 2, one apart.
    return np.bitwise_count(one | two).astype(np.int64) + np.bitwise_count(two & ~one)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, row: Column | None = None) -> DataFrame:
    """``doc_id, row, fp, component_id``: the smallest doc_id that is reachable over links, itself included."""
    marked = written(fingerprints(docs, shingle, row), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct, bits))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "row", "fp", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_dedup": op3_simhash_near_dedup}
ORACLES: dict[str, str] = {}
