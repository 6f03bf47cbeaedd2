"""Card readings: append, owner, last reading, voiding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import attendance as fn
from tallyroom.operators.ordered import with_halo
from tallyroom.sources.tables import fixed_rows

LOOK_MINUTES = 5
VOID_MINUTES = 6


def append_reading(swipes: DataFrame) -> DataFrame:
    """Rows ready to append from ``swipes(tagId, ts, action)``, stamped to the second."""
    return swipes.select("tagId", fn.second_stamp(F.col("ts")).alias("time"), "action")


def write_readings(rows: DataFrame, path: str) -> None:
    rows.select("tagId", "time", "action").write.mode("append").parquet(path)


def first_card(cards: DataFrame) -> DataFrame:
    """One user per tag; the smallest id where a tag was given out twice."""
    return cards.groupBy("tagId").agg(F.min("userId").alias("userId"))


def card_owners(cards: DataFrame, users: DataFrame) -> DataFrame:
    """``(tagId, owner)``, joined before the readings so that the wide side joins once."""
    label = fn.ascii_fold(F.concat_ws(", ", "surname", "name"))
    return (
        first_card(cards)
        .join(users.withColumnRenamed("id", "userId"), "userId")
        .select("tagId", label.alias("owner"))
    )


def reading_owner(readings: DataFrame, cards: DataFrame, users: DataFrame) -> DataFrame:
    """Readings with the label of the card's owner, or the fallback text."""
    joined = readings.join(card_owners(cards, users), "tagId", "left")
    return joined.select(
        *readings.columns, F.coalesce("owner", F.lit(fn.UNKNOWN_CARD)).alias("owner")
    )


def card_match(uids: DataFrame) -> DataFrame:
    """Name of the known card a UID equals. The known cards are a fixed list of three."""
    known = fixed_rows(
        uids.sparkSession, [{"card": name, "_uid": uid} for name, uid in fn.KNOWN_CARDS],
        "card string, _uid array<int>")
    joined = uids.join(F.broadcast(known), F.col("uid") == F.col("_uid"), "left")
    return joined.select(*uids.columns, F.coalesce("card", F.lit(fn.WRONG_CARD)).alias("card"))


def latest_one(readings: DataFrame) -> DataFrame:
    """Latest reading per tag. An aggregate, so each task first keeps one row per tag."""
    newest = F.max_by(F.struct("time", "action"), F.struct("time", "event_id")).alias("r")
    return readings.groupBy("tagId").agg(newest).select("tagId", "r.time", "r.action")


def last_reading(readings: DataFrame, as_of: Column, minutes: int = LOOK_MINUTES) -> DataFrame:
    """Latest reading per tag strictly inside the lookback before ``as_of``."""
    stamp = F.col("time")
    recent = readings.where(
        (stamp > fn.lookback_bound(as_of, minutes)) & (stamp <= fn.second_stamp(as_of))
    )
    return latest_one(recent)


def previous_reading(
    readings: DataFrame, minutes: int = LOOK_MINUTES, width: int = 3600
) -> DataFrame:
    """For every reading, the one before it on the same tag if it is inside the lookback."""
    seconds = fn.stamp_seconds(F.col("time"))
    ranged = with_halo(readings.withColumn("_sec", seconds), F.col("_sec"), width, before=minutes * 60)
    order = Window.partitionBy("tagId", "_range").orderBy("time", "event_id")
    before = F.lag(F.struct("_sec", "time", "action")).over(order)
    near = F.col("_sec") - F.col("_b._sec") < minutes * 60
    return (
        ranged.withColumn("_b", before)
        .where("_core")
        .select(
            *readings.columns,
            F.when(near, F.col("_b.time")).alias("prev_time"),
            F.when(near, F.col("_b.action")).alias("prev_action"),
        )
    )


def void_last_reading(readings: DataFrame, requests: DataFrame, minutes: int = VOID_MINUTES) -> DataFrame:
    """Readings left after one request ``(tagId, at)`` per tag, each voiding the latest one.

    A tag with more requests belongs in ``void_readings``.
    """
    bounds = requests.select(
        "tagId",
        fn.lookback_bound(F.col("at"), minutes).alias("_from"),
        fn.second_stamp(F.col("at")).alias("_to"),
    )
    voided = (
        readings.join(bounds, "tagId")
        .where((F.col("time") > F.col("_from")) & (F.col("time") <= F.col("_to")))
        .groupBy("tagId")
        .agg(F.max(F.struct("time", "event_id")).alias("_v"))
        .select("tagId", "_v.event_id")
    )
    return readings.join(voided, ["tagId", "event_id"], "left_anti")


def void_readings(log: DataFrame, minutes: int = VOID_MINUTES, width: int = 3600) -> DataFrame:
    """Readings left after every void request of ``log(tagId, time, event_id, action, is_void)``.

    Requests and readings of a tag pair like brackets: a request takes the latest reading
    not yet taken, and does nothing when that reading is too old. Whether a reading and a
    request pair depends only on the rows between them, so each time range decides its own
    readings with ``minutes`` of what follows. Depth is the running count of readings minus
    requests; a reading's partner is the next row that crosses the same depth.
    """
    seconds = fn.stamp_seconds(F.col("time"))
    ranged = with_halo(log.withColumn("_sec", seconds), F.col("_sec"), width, after=minutes * 60)
    order = Window.partitionBy("tagId", "_range").orderBy("time", "event_id")
    step = F.when(F.col("is_void"), F.lit(-1)).otherwise(F.lit(1))
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    level = depth + F.when(F.col("is_void"), F.lit(1)).otherwise(F.lit(0))
    crossing = Window.partitionBy("tagId", "_range", "_level").orderBy("time", "event_id")
    partner = F.lead(F.struct("_sec", "event_id")).over(crossing)
    taken = F.col("_p._sec") - F.col("_sec") < minutes * 60
    return (
        ranged.withColumn("_level", level)
        .withColumn("_p", partner)
        .where(F.col("_core") & ~F.col("is_void") & ~F.coalesce(taken, F.lit(False)))
        .select(*log.columns)
    )
