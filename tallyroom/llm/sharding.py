"""Contiguous shards of least maximum size over ordered atomic groups.

Groups are the rows of equal text (null counts as empty), ordered by a digest of the text.
The smallest feasible capacity is found by binary search with the greedy check: fill a
shard up to the capacity, cut, go on. The driver does not hold groups but sums of ranges of
digests: first those of the leading three hexadecimal digits, then finer ones only where a
cut falls inside a range. A check that may cut anywhere in such a range gives a lower bound
of the capacity; once no cut of it falls inside one, the bound is reached. Each step holds a
few thousand sums whatever the number of groups.

With that capacity as the limit, cuts are then levelled: each is put at the boundary nearest
to an equal share of what is left, from which the rest still fits.

A null text has size 1. Rows that share an id are numbered one by one; rows without an id are too.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import documents, written

FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Ranges on both sides of one with a cut in it that are refined with it.
AROUND = 1
#: Rows of a shard are numbered in so many parts.
PARTS = 1024


@dataclass
class Ranges:
    """Sums of consecutive ranges of group keys; a range of one group is ``single``."""

    prefixes: list[str]
    sums: list[int]
    single: list[bool]
    last: list[str]
    ends: list[int] = field(init=False)

    def __post_init__(self):
        total, self.ends = 0, []
        for s in self.sums:
            total += s
            self.ends.append(total)

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def inside(self, at: int) -> int | None:
        """The range of several groups that a position falls inside, if one does."""
        k = bisect_left(self.ends, at)
        if k < len(self.ends) and self.ends[k] != at and at > self.ends[k] - self.sums[k] and not self.single[k]:
            return k
        return None

    def down(self, at: int) -> int:
        """The last boundary at or before a position."""
        k = bisect_right(self.ends, at)
        return self.ends[k - 1] if k else 0

    def up(self, at: int) -> int:
        """The first boundary at or after a position."""
        return self.ends[bisect_left(self.ends, at)] if at > 0 else 0


def greedy(r: Ranges, capacity: int, shards: int) -> tuple[bool, set[int]]:
    """Whether the shards hold everything, and the ranges that had to be cut inside."""
    at, touched = 0, set()
    for _ in range(shards):
        goal = at + capacity
        if goal >= r.total:
            return True, touched
        k = r.inside(goal)
        if k is not None:
            touched.add(k)
            at = goal
        else:
            at = r.down(goal)
    return False, touched


def smallest(r: Ranges, shards: int) -> int:
    low, high = -(-r.total // shards), r.total
    while low < high:
        middle = (low + high) // 2
        if greedy(r, middle, shards)[0]:
            high = middle
        else:
            low = middle + 1
    return low


def level(r: Ranges, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Cuts near equal shares that keep every shard within the capacity, and the ranges they fell inside."""
    touched: set[int] = set()

    def note(at: int) -> None:
        if (k := r.inside(at)) is not None:
            touched.add(k)

    least, at = [0] * shards, r.total
    for k in range(shards - 1, 0, -1):
        note(at - capacity)
        at = least[k] = r.up(max(0, at - capacity))
    cuts, at = [], 0
    for k in range(1, shards):
        goal = at + round((r.total - at) / (shards - k + 1))
        low, high = max(at, least[k]), at + capacity
        note(goal)
        note(high)
        down, up = r.down(min(goal, high)), r.up(min(goal, r.total))
        best = min((x for x in (down, up, r.down(high)) if low <= x <= high), key=lambda x: (abs(x - goal), x), default=r.down(high))
        cuts.append(best)
        at = best
    return cuts, touched


def _refined(groups: DataFrame, r: Ranges | None, chosen: set[int]) -> Ranges:
    """The ranges again, the chosen ones by two more digits; all by the first digits if there were none."""
    parts: dict[int, list] = {}
    if r is None:
        parts[FIRST_DIGITS] = []
    else:
        for k in chosen:
            parts.setdefault(len(r.prefixes[k]) + MORE_DIGITS, []).append(r.prefixes[k])
    rows = []
    for digits, old in parts.items():
        some = groups.where(F.substring("key", 1, digits - MORE_DIGITS).isin(old)) if old else groups
        rows += some.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
            F.sum("size").alias("size"), F.min("key").alias("first"), F.max("key").alias("last")).collect()  # at most 4,096 + 256 for each chosen one
    rows = [(x["prefix"], x["size"], x["first"] == x["last"], x["last"]) for x in rows]
    if r is not None:
        rows += [x for k, x in enumerate(zip(r.prefixes, r.sums, r.single, r.last)) if k not in chosen]
    rows.sort()
    return Ranges(*([x[i] for x in rows] for i in range(4)))


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity for contiguous shards, and the last key of each shard but the last."""
    r = _refined(groups, None, set())
    while True:
        capacity = smallest(r, shards)
        touched = greedy(r, capacity, shards)[1]
        places: list[int] = []
        if not touched:
            places, touched = level(r, capacity, shards)
        if not touched:
            break
        near = {k + d for k in touched for d in range(-AROUND, AROUND + 1) if 0 <= k + d < len(r.sums)}
        r = _refined(groups, r, {k for k in near if not r.single[k]})
    return capacity, [r.last[bisect_left(r.ends, p)] if p > 0 else "" for p in places] if r.total else []


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        F.col("doc_id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32).alias("key")), "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, ends = cuts(groups, shards)
    where = sum([(F.col("key") > e).cast("int") for e in ends], F.lit(0))
    placed = rows.select("doc_id", "row", "size", "text_crc32", where.alias("shard"), F.pmod(F.xxhash64("doc_id", "row"), F.lit(PARTS)).alias("part"))
    before = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select(  # at most PARTS rows for each shard
        "shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return placed.join(before, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + number - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


QUERIES = {"op5_minimax_shards": op5_minimax_shards}
ORACLES: dict[str, str] = {}
