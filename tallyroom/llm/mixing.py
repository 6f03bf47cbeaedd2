"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its documents is expected to have.
The whole part is given; what is left is a probability, and pairs of such documents are
rounded against each other: words move from one to the other, in either direction with the
chances that keep both expectations, until one probability is 0 or 1. The other
goes on to the next pair. So a source's words stay exact up to the one document that is left.

Documents of a source are dealt to buckets of bounded size; the one left over in each
bucket goes up a tree of buckets of buckets until a single one is left, which is rounded alone.
Draws are hashes of the row's id and a seed, so reruns agree.

Null text has size 0. Rows without a source form a source of their own, the last. Rows that share an id
are documents of their own. A document without words is copied like others and adds no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, n_words, numbered, unpacked, written

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
#: Documents of a bucket and buckets of a bucket above.
BUCKET, FAN = 2000, 64
SEED = 7
_FIELDS = [("source", pa.string()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("size", pa.int64()),
           ("p", pa.float64()), ("given", pa.int64()), ("done", pa.bool_())]
SCHEMA = "source string, bucket long, doc_id long, row long, size long, p double, given long, done boolean"


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, n, target. ``sizes``: source, size. Source by code point takes the weights in turn.

    Targets are proportional to weights with a ceiling for each source; the excess is shared out again
    until none is above, which is one level for all sources below their ceiling.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source from here on
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * MOST_COPIES).cast("double")
    each = each.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    done, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    each = each.withColumn("level", (F.sum("source_size").over(whole) * SHARE - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(ahead))
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    return each.select("source", "source_size", "n", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)).alias("target"))


def _draw(*key: object) -> float:
    return xxhash.xxh3_64_intdigest(repr(key).encode(), SEED) / 2**64


def pivot(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """(row, size, p) of two documents after one transfer: at least one p is 0 or 1, size * p keeps its sum."""
    (i, s, p), (j, t, q) = a, b
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)  # words that a can gain from b and lose to it
    if _draw(i, j) * (up + down) < down:
        p, q = (1.0, q - up / t) if up == (1 - p) * s else (p + up / s, 0.0)
    else:
        p, q = (0.0, q + down / t) if down == p * s else (p - down / s, 1.0)
    return (i, s, _whole(p)), (j, t, _whole(q))


def _whole(p: float) -> float:
    return 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


def _round(last: bool):
    """Rows sorted by source and bucket, with one document that is not done for each bucket at most, and none if ``last``."""

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, None  # held: the row of the group that is still open

        def closed(row: list) -> tuple:
            if last and not row[7]:
                row[5], row[7] = float(_draw(row[3]) < row[5]), True
            return tuple(row)

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names)):
                row = list(row)
                if row[:2] != group:
                    if held:
                        out.append(closed(held))
                    group, held = row[:2], None
                p = _whole(row[5])
                if p in (0.0, 1.0) or row[4] == 0:
                    row[5], row[7] = float(p if p in (0.0, 1.0) else _draw(row[3]) < p), True
                    out.append(tuple(row))
                    continue
                if held is None:
                    held = row
                    continue
                (_, _, x), (_, _, y) = pivot((held[3], held[4], held[5]), (row[3], row[4], p))
                held[5], row[5] = x, y
                for r in (held, row):
                    if r[5] in (0.0, 1.0):
                        r[7] = True
                        out.append(tuple(r))
                held = next((r for r in (held, row) if not r[7]), None)
            yield _record(out)
        if held:
            yield _record([closed(held)])

    return rounded


def _record(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], [n for n, _ in _FIELDS])


def copies(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, row, size, source_size, target, copies. ``row`` tells rows of one id apart and is any number without it."""
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.monotonically_increasing_id() if row is None else row).alias("row"),
                               F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    goals = written(targets(rows), "targets")
    most = goals.agg(F.max("n")).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    g = goals.select(F.col("source").alias("s"), rate.alias("rate"), F.ceil(F.col("n") / BUCKET).alias("buckets"))
    level = rows.join(g, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", F.pmod(F.xxhash64("doc_id", "row"), F.col("buckets")).alias("bucket"), "doc_id", "row", "size",
        (F.col("rate") - F.floor("rate")).alias("p"), F.floor("rate").alias("given"), F.lit(False).alias("done"))
    buckets, found = -(-most // BUCKET), []
    while True:
        # Large documents first, so that the one left over tends to be a small one.
        dealt = level.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.col("size").desc(), "doc_id", "row")
        level = written(dealt.mapInArrow(_round(buckets <= 1), SCHEMA), "rounded")
        found.append(level.where("done"))
        if buckets <= 1:
            break
        level = level.where("not done").withColumn("bucket", F.floor(F.col("bucket") / FAN))
        buckets = -(-buckets // FAN)
    settled = found[0]
    for more in found[1:]:
        settled = settled.unionAll(more)
    g = goals.select(F.col("source").alias("s"), "source_size", "target")
    return settled.join(g, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "row", "size", "source_size", "target", (F.col("given") + F.col("p").cast("long")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    names, table = docs.columns, numbered(docs)
    taken = copies(table.select("_id", *unpacked(names, ["doc_id", "source", "text"])), F.col("_id")).where("copies > 0")
    joined = table.join(taken.select(F.col("row").alias("_id"), "copies"), "_id")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*unpacked(names))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op7_pivotal_mixing": op7_pivotal_mixing}
ORACLES: dict[str, str] = {}
