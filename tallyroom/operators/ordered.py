"""Ordered analytics that survive a dominating key.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a
key is cut into ranges of its own order (``bucket`` must not decrease along the
order), the window runs inside ``(key, bucket)``, and one summary row per bucket
carries what earlier buckets contribute. The wide rows are shuffled once, by
``(key, bucket)``; the summaries are joined back on the same hash keys, so the join adds no
shuffle of the wide rows. Summaries come from the same shuffle where the caller keeps all
columns (``once``), so the input is evaluated once; otherwise they are combined on the map
side from the few columns they need.

Where buckets are ranges of a position, ``with_ranges`` takes them from a sketch of each key's
quantiles, so a burst is cut as finely as it is dense, and no job runs before the query does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tallyroom.operators.lookup import lookup
from tallyroom.workspace import stage

_BUCKET = "_bucket"


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None,
    sums: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    partitioned: bool = False,
    once: bool = False,
    written: bool = False,
) -> DataFrame:
    """Add running sums and minima up to and with each row, and values of the row before.

    Keys and order columns must not be null, and the order must be total within a key.
    The rows are spread by key and bucket explicitly, since a coarser partitioning left by
    an earlier join on the keys would satisfy the window too and keep a hot key whole;
    Without ``bucket`` the rows carry the ranges of ``with_ranges``. ``partitioned`` says that they already are spread so. ``once`` is for callers that use all
    columns of the result. ``written`` has rows and their windows written first, so that a costly input is evaluated once and the
    summaries, which are read from the few columns they need, are measured; it runs jobs while the query is built.
    """
    sums, mins, previous = sums or {}, mins or {}, previous or {}
    cut = df if bucket is None else df.withColumn(_BUCKET, bucket)
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    spread = cut if partitioned else cut.repartition(*keys, _BUCKET)
    local = spread.select(
        "*",
        *[F.sum(e).over(upto).alias(f"_l_{n}") for n, e in sums.items()],
        *[F.min(e).over(upto).alias(f"_l_{n}") for n, e in mins.items()],
        *[F.lag(F.struct(e.alias("v"))).over(inside).alias(f"_l_{n}") for n, e in previous.items()],
    )
    if written:
        local, once = stage(local), False
    # A summary that mentions every column needs the same shuffle as the rows, which Spark then runs once.
    every = [F.size(c) if isinstance(cut.schema[c].dataType, MapType) else F.col(f"`{c}`") for c in cut.columns]
    mention = [F.max(F.xxhash64(*every)).alias("_every")] if once else [F.lit(0).alias("_every")]
    summary = (local if written else spread if once else cut).groupBy(*keys, _BUCKET).agg(
        *mention,
        *[F.sum(e).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.min(e).alias(f"_s_{n}") for n, e in mins.items()],
        *[F.max_by(F.struct(e.alias("v")), F.struct(*order)).alias(f"_s_{n}") for n, e in previous.items()],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    # The first range of a key has nothing before it, so keys of one range have no row here.
    carried = summary.where("_every is not null").select(
        *keys,
        _BUCKET,
        F.count("*").over(earlier).alias("_ranges"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.min(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in mins],
        *[F.last(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in previous],
    ).where("_ranges > 0").drop("_ranges")
    joined = lookup(local, carried, [*keys, _BUCKET]) if written else local.join(carried, [*keys, _BUCKET], "left")
    return joined.select(
        *[c for c in df.columns if c != _BUCKET],
        *[
            (F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0)))
            .cast("bigint").alias(n)
            for n in sums
        ],
        *[F.least(f"_c_{n}", f"_l_{n}").alias(n) for n in mins],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}"))["v"].alias(n) for n in previous],
    )


def with_ranges(df: DataFrame, keys: list[str], position: Column, ranges: int = 256) -> DataFrame:
    """Give ``running`` its ranges: those of ``position``, a number, that hold about as many rows of a key each.

    The cuts come from a sketch of each key's quantiles; a position that holds many rows is one range, and ties are never cut.
    """
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx(position, steps, 4 * ranges))).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c <= position)).cast("bigint")
    return df.join(cuts, keys).withColumn(_BUCKET, place).drop("_cuts")


def range_width(df: DataFrame, position: Column, rows: int = 3_000_000, least: int = 60, most: int = 86400) -> int:
    """Width of ranges of ``position`` that hold about ``rows`` rows each.

    One narrow aggregate over the table; its single row decides the width, so the same
    query cuts a hot key into few ranges on little data and into many on much.
    """
    n, low, high = df.agg(F.count("*"), F.min(position), F.max(position)).first()
    if not n or high == low:
        return most
    return int(min(most, max(least, (high - low) * rows / n)))


def with_halo(
    df: DataFrame, seconds: Column, width: int, before: int = 0, after: int = 0
) -> DataFrame:
    """Assign rows to time ranges of ``width`` seconds and repeat edge rows in the neighbour.

    ``_range`` names the range and ``_core`` tells an own row from a repeated one. A range
    sees ``before`` seconds of its predecessor and ``after`` seconds of its successor, so
    any relation that spans no more than that is decided inside one range with one shuffle.
    """
    if max(before, after) > width:
        raise ValueError("the halo must not be wider than the range")
    own = F.floor(seconds / F.lit(width)).cast("bigint")
    into = F.pmod(seconds, F.lit(width))
    copies = [F.struct(own.alias("_range"), F.lit(True).alias("_core"))]
    nothing = F.lit(None).cast("struct<_range:bigint,_core:boolean>")
    if before:
        copies.append(F.when(into >= width - before, F.struct((own + 1).alias("_range"), F.lit(False).alias("_core"))).otherwise(nothing))
    if after:
        copies.append(F.when(into <= after, F.struct((own - 1).alias("_range"), F.lit(False).alias("_core"))).otherwise(nothing))
    return df.select("*", F.inline(F.filter(F.array(*copies), lambda c: c.isNotNull())))
