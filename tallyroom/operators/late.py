"""The late rule over arrivals: sequential by nature, computed by composing blocks.

A row below the bound is dropped. A kept row below the kept row before it is late, and the bound rises to it. After
a late row the state is that row and nothing else, which is what makes blocks composable: for a block of
``BLOCK`` arrivals the state at its end depends on the state before it only through

- the first row at or above the bound, which is a running maximum of the block; it is late or not;
- if it is not, the first row at or above the bound that is below a maximum before it: the first late one.

So a block is summed up by these candidates (``entry`` and ``drop``), each with the state at the block's end. Only
candidates between the lowest and the highest possible bound are kept: the bound the arrivals start with and the
greatest stamp before the block. Blocks of a namespace are then chained by two binary searches each, and a last pass marks rows
from the known state at their block's start.

Simulations run on many blocks at once, position by position, on arrays; nothing loops over rows. A log of n rows takes
a shuffle by arrival, one of stamps and one of rows by block, and one of n / ``BLOCK`` summaries by namespace. Blocks are
cut by number, so a burst or a namespace that holds most of the log is split like any other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.workspace import stage

#: Arrivals in a block, in the pieces that its stamps are handed over in, and in the blocks that a task holds at a time.
BLOCK, PIECE, AT_ONCE = 1024, 16, 100_000
STATE_SCHEMA = "namespace string, bound string, previous string"
_CASES = "array<struct<stamp:string,bound:string,previous:string>>"
_KEYS = ["namespace", "_block"]


class _Codes:
    """Stamps as numbers in text order: 0 is none, and -1 stands where a block has no row."""

    def __init__(self, *columns: pa.Array):
        known = pa.concat_arrays([pc.cast(pc.drop_null(c), pa.string()) for c in columns]).unique()
        self.known = known.take(pc.sort_indices(known))

    def of(self, column: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.add(pc.index_in(pc.cast(column, pa.string()), self.known), 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def back(self, codes: np.ndarray) -> pa.Array:
        return self.known.take(pa.array(codes - 1, mask=codes == 0))


def _grid(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A column for each block."""
    grid = np.full((int(sizes.max(initial=0)), len(sizes)), -1, np.int64)
    block = np.repeat(np.arange(len(sizes)), sizes)
    grid[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), block] = codes
    return grid


def _before(grid: np.ndarray) -> np.ndarray:
    """The running maximum up to the row above."""
    top = np.maximum.accumulate(grid, axis=0)
    return np.vstack([np.full((1, grid.shape[1]), -1), top[:-1]])


def _candidates(grid: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a block's entries and drops are."""
    above = _before(grid)
    fallen = np.where(grid < above, grid, -1)
    above_fallen = _before(fallen)
    possible = grid >= np.maximum(low, 1)
    return (grid > above) & (above < high) & possible, (fallen > above_fallen) & (above_fallen < high) & possible


def _ends(grid: np.ndarray, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bound and previous at the end of the block if the row ``at`` was late."""
    bound = grid[at, block]
    previous = bound.copy()
    for k in range(1, grid.shape[0]):
        stamp = grid[k, block]
        kept = (stamp >= bound) & (at < k)
        late = kept & (stamp < previous)
        bound = np.where(late, stamp, bound)
        previous = np.where(kept, stamp, previous)
    return bound, previous


def _marks(grid: np.ndarray, bound: np.ndarray, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept, late and check of each row of a grid."""
    out = np.zeros((3, *grid.shape), bool)
    for k in range(grid.shape[0]):
        stamp = grid[k]
        kept = stamp >= np.maximum(bound, 1)
        late = kept & (stamp < previous)
        bound = np.where(late, stamp, bound)
        previous = np.where(kept, stamp, previous)
        out[:, k] = kept, late, kept & (stamp == bound)
    return tuple(out)


def _cases(codes: _Codes, grid: np.ndarray, where: np.ndarray) -> pa.Array:
    """For each block the candidates in ascending order, with the state each leads to."""
    block, at = np.nonzero(where.T)
    ends = _ends(grid, at, block)
    values = pa.StructArray.from_arrays([codes.back(grid[at, block]), *map(codes.back, ends)], ["stamp", "bound", "previous"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(block, np.arange(grid.shape[1] + 1)), pa.int32()), values)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where a block begins in rows that hold its parts side by side."""
    space, block = batch.column("namespace"), batch.column("_block").to_numpy(zero_copy_only=False)
    names = pc.index_in(space, space.unique()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (names[1:] != names[:-1])])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of blocks in runs of about AT_ONCE stamps, each ending where a block does."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column("stamps").flatten())
        if n < AT_ONCE:
            continue
        run = _joined(held)
        last = int(_starts(run)[-1])
        if last:
            yield run.slice(0, last)
        held = [_joined([run.slice(last)])]
        n = len(held[0].column("stamps").flatten())
    if n:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch with the rows of all, which keeps nothing else of them."""
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(c) for b in batches]) for c in batches[0].schema.names], batches[0].schema.names)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _whole(batches):
        starts = _starts(run)
        lengths = pc.list_value_length(run.column("stamps")).to_numpy(zero_copy_only=False)
        sizes, ends = np.add.reduceat(lengths, starts), np.r_[starts, run.num_rows]
        for part in _parts(sizes):
            batch = run.slice(int(ends[part.start]), int(ends[part.stop] - ends[part.start]))
            heads = batch.take(pa.array(starts[part.start : part.stop] - starts[part.start]))
            stamps, low, high = batch.column("stamps").flatten(), heads.column("low"), heads.column("high")
            codes = _Codes(stamps, low, high)
            grid = _grid(codes.of(stamps), sizes[part.start : part.stop])
            entry, drop = _candidates(grid, codes.of(low), codes.of(high))
            yield pa.RecordBatch.from_arrays(
                [*(heads.column(c) for c in _KEYS), _cases(codes, grid, entry), _cases(codes, grid, drop), codes.back(grid.max(axis=0))],
                [*_KEYS, "entry", "drop", "greatest"])


def _parts(sizes: np.ndarray) -> Iterator[range]:
    """Runs of blocks whose grid has AT_ONCE places at most."""
    start, most = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if max(most, size) * (k + 1 - start) > AT_ONCE and k > start:
            yield range(start, k)
            start, most = k, 0
        most = max(most, size)
    if len(sizes):
        yield range(start, len(sizes))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block, and with a null block the state after the last one, of namespaces in order."""
    space, bound, previous, out = None, None, None, []
    names = [*_KEYS, "bound", "previous"]
    as_batch = lambda: pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], names)
    for batch in batches:
        columns = [batch.column(c) for c in ("namespace", "_block", "entry", "drop", "greatest", "bound", "previous")]
        for k in range(batch.num_rows):  # a block each
            here, block, entry, drop, greatest, first_bound, first_previous = (c[k].as_py() for c in columns)
            if here != space:
                if space is not None:
                    out.append((space, None, bound, previous))
                space, bound, previous = here, first_bound, first_previous
            out.append((space, block, bound, previous))
            stamp = lambda case: case["stamp"]
            at = 0 if bound is None else bisect_left(entry, bound, key=stamp)
            if at == len(entry):
                continue  # all of it is dropped
            if previous is not None and entry[at]["stamp"] < previous:
                bound, previous = entry[at]["bound"], entry[at]["previous"]
                continue
            at = 0 if bound is None else bisect_left(drop, bound, key=stamp)
            bound, previous = (drop[at]["bound"], drop[at]["previous"]) if at < len(drop) else (bound, greatest)
        if out:
            yield as_batch()
            out = []
    if space is not None:
        out = [(space, None, bound, previous)]
        yield as_batch()


def _judged(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their blocks with their marks. A block that goes on in the next batch takes its state along."""
    held: tuple = (None, None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        space, block, starts = batch.column("namespace"), batch.column("_block"), _starts(batch)
        codes_of = _Codes(batch.column("timestamp"), batch.column("_bound"), batch.column("_previous"), pa.array(held[1:], pa.string()))
        sizes = np.diff(starts, append=len(block))
        codes = codes_of.of(batch.column("timestamp"))
        bound, previous = codes_of.of(batch.column("_bound"))[starts], codes_of.of(batch.column("_previous"))[starts]
        if held[0] == (space[0].as_py(), block[0].as_py()):
            bound[0], previous[0] = codes_of.of(pa.array(held[1:], pa.string()))
        grid = _grid(codes, sizes)
        marks = _marks(grid, bound, previous)
        at = np.arange(len(codes)) - np.repeat(starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
        kept, late, check = (m[at] for m in marks)
        tail = slice(int(starts[-1]), None)
        last_kept, last_late = codes[tail][kept[tail]], codes[tail][late[tail]]
        end = np.array([last_late[-1] if len(last_late) else bound[-1], last_kept[-1] if len(last_kept) else previous[-1]])
        held = ((space[-1].as_py(), block[-1].as_py()), *codes_of.back(end).to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, (kept, late, check))], [*columns, "kept", "late", "check"])


def no_state(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([], STATE_SCHEMA)


def late_data(events: DataFrame, order: list[str], start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply the late rule in arrival order per namespace; returns rows and the final state.

    ``events`` gains ``kept``, ``late`` and ``check`` (a kept row that equals the bound). ``start`` and the final state
    are ``(namespace, bound, previous)``; a namespace without arrivals keeps its state. Stamps are text of
    fixed width and not null; ``order`` must be total within a namespace.
    """
    columns = list(events.columns)
    start = no_state(events) if start is None else start.select("namespace", "bound", "previous")
    # A block is 1,024 rows of a task at most, and fewer where a namespace ends.
    spread = events.repartitionByRange("namespace", *order).sortWithinPartitions("namespace", *order)
    rows = stage(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.floor(F.col("_at") / BLOCK).cast("bigint")))
    stamps = F.transform(F.sort_array(F.collect_list(F.struct("_at", "timestamp"))), lambda x: x["timestamp"])
    blocks = rows.groupBy(*_KEYS).agg(stamps.alias("stamps"), F.max("timestamp").alias("_greatest"))  # at most BLOCK stamps each
    earlier = Window.partitionBy("namespace").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = start.select("namespace", F.col("bound").alias("_b"), F.col("previous").alias("_p"))
    tops = rows.groupBy(*_KEYS).agg(F.max("timestamp").alias("_greatest")).join(first, "namespace", "left")
    limits = tops.select(*_KEYS, F.col("_b").alias("low"), F.greatest(F.max("_greatest").over(earlier), "_b", "_p").alias("high"))
    # A batch holds so many rows, whatever is in them, so a block is handed over in pieces that follow each other.
    pieces = F.transform(F.sequence(F.lit(1), F.size("stamps"), F.lit(PIECE)), lambda i: F.slice("stamps", i, F.lit(PIECE)))
    summed = blocks.join(limits, _KEYS).select(*_KEYS, "low", "high", F.explode_outer(pieces).alias("stamps")).mapInArrow(
        _summaries, f"namespace string, _block bigint, entry {_CASES}, drop {_CASES}, greatest string")
    chain = summed.join(start, "namespace", "left").repartition("namespace").sortWithinPartitions(*_KEYS)
    states = stage(chain.mapInArrow(_chained, "namespace string, _block bigint, bound string, previous string"))

    begin = states.where("_block is not null").select(*_KEYS, F.col("bound").alias("_bound"), F.col("previous").alias("_previous"))
    near = rows.join(begin, _KEYS).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "_at")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    judged = near.mapInArrow(lambda batches: _judged(batches, columns), f"{fields}, kept boolean, late boolean, check boolean")
    final = states.where("_block is null").select("namespace", "bound", "previous")
    return judged, final.unionByName(start.join(final, "namespace", "left_anti"))
