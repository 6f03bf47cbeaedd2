"""Mail-server events: parsing, restart bound, duplicates, lateness, exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import events as fn
from tallyroom.operators.lookup import lookup
from tallyroom.operators.ordered import running, with_ranges

EVENT = ["namespace", "mailId", "timestamp", "message"]
EVENT_SCHEMA = "namespace string, mailId string, timestamp string, message string"


def parse_log(lines: DataFrame) -> DataFrame:
    """Lines ``(namespace, value, ...)`` as events; lines of another shape are dropped."""
    value = F.col("value")
    others = [c for c in lines.columns if c not in ("namespace", "value")]
    return lines.where(fn.is_log_line(value)).select(
        "namespace", *others,
        fn.line_id(value).alias("mailId"), fn.line_time(value).alias("timestamp"), fn.line_text(value).alias("message"))


def max_ts_by_namespace(events: DataFrame) -> DataFrame:
    return events.groupBy("namespace").agg(F.substring(F.max("timestamp"), 1, 19).alias("last"))


def since_watermark(events: DataFrame, last: DataFrame) -> DataFrame:
    """Events not before the last stored second of their namespace."""
    joined = lookup(events, last, ["namespace"])
    return joined.where(F.col("last").isNull() | (F.col("last") <= F.col("timestamp"))).select(*events.columns)


def event_not_seen(events: DataFrame, stored: DataFrame, last: DataFrame) -> DataFrame:
    """Events to store: those at the boundary second only once and only if not stored yet.

    Boundary rows are made distinct on the map side first, so that any number of copies of
    one line costs one row per task; stored rows are read at the boundary second only. No row is
    shuffled by its namespace.
    """
    bounded = lookup(events.select(*EVENT), last, ["namespace"])
    at_bound = F.coalesce(F.col("timestamp") == F.col("last"), F.lit(False))
    seen = lookup(stored, last.withColumnRenamed("last", "timestamp"), ["namespace", "timestamp"], "left_semi")
    fresh = bounded.where(at_bound).select(*EVENT).distinct().join(seen.select(*EVENT).distinct(), EVENT, "left_anti")
    return bounded.where(~at_bound).select(*EVENT).unionByName(fresh.select(*EVENT))


def out_of_order(events: DataFrame, order: list[str]) -> DataFrame:
    """Events earlier than the one that arrived before them in their namespace. ``order`` begins with a number."""
    ranged = with_ranges(events, ["namespace"], F.col(order[0]))
    before = running(ranged, ["namespace"], order, None, previous={"previous": F.col("timestamp")}, once=True)
    return before.where(F.col("timestamp") < F.col("previous"))


def ban_sessions(failures: DataFrame, seconds: int) -> DataFrame:
    """Failures merged into periods that end ``seconds`` after the last one.

    A failure exactly at the end starts a new period, and session windows merge at their
    end, so the gap is a microsecond short and the end puts it back.
    """
    session = F.session_window("fail_ts", f"{seconds * 1000000 - 1} microseconds").alias("s")
    return failures.groupBy("provider", session).agg(F.count("*").alias("n_failures")).select(
        "provider", F.col("s.start").alias("ban_start"),
        (F.col("s.end") + F.expr("interval 1 microsecond")).alias("ban_end"), "n_failures")


def ban_periods(failures: DataFrame, seconds: int = 60) -> DataFrame:
    """Exclusion periods of ``(provider, fail_ts)``: each failure moves the end.

    Failures are first made distinct per second, so a provider costs at most one row per
    second in the session merge, however often it failed.
    """
    once = failures.select("provider", "fail_ts").distinct()
    return ban_sessions(once, seconds).drop("n_failures")
