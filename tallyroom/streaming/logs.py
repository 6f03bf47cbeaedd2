"""Log ingestion as streaming queries that run until all landed segments are read, and go on where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import events as op, late
from tallyroom.sources import logs, store
from tallyroom.workspace import stage

#: The batch number of what a run starts from.
BEGIN = -1


def drain(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def restart_point(spark: SparkSession, target: str, run: str, origin: str) -> None:
    """Note once for a run from which second of each namespace it reads: the last one stored by then."""
    if not store.is_committed(spark, target, BEGIN, run, origin):
        events = store.read_batches(spark, target, op.EVENT_SCHEMA)
        last = op.max_ts_by_namespace(events).select("namespace", F.col("last").alias("bound"), F.lit(None).cast("string").alias("previous"))
        store.write_batch({"rows": events.limit(0), "state": last}, target, BEGIN, run, origin)


def to_insert(spark: SparkSession, kept: DataFrame, order: list[str], target: str) -> DataFrame:
    """Of kept rows ``(EVENT, check, order)`` those to store: a row at the bound only if no equal one is stored or kept before it.

    Stored rows are read for the seconds in question only, which the files' statistics find.
    """
    checks = kept.where("check")
    low, high = checks.agg(F.min("timestamp"), F.max("timestamp")).first()
    plain = kept.where("not check").select(*op.EVENT)
    if low is None:
        return plain
    near = kept.join(checks.select("namespace", "timestamp").distinct(), ["namespace", "timestamp"], "left_semi")
    first = near.groupBy(*op.EVENT).agg(F.min(F.struct(*order, "check")).alias("first")).where("first.check")
    stored = store.read_batches(spark, target, op.EVENT_SCHEMA).where(F.col("timestamp").between(low, high))
    return plain.unionByName(first.join(stored.distinct(), op.EVENT, "left_anti").select(*op.EVENT))


def ingest(spark: SparkSession, lines: DataFrame, target: str, checkpoint: str, run: str | None = None) -> None:
    """The log pipeline: a stream of lines ``(namespace, value, file, block)`` parsed, held to the late rule, checked at the bound, stored.

    A run starts from the last stored second of each namespace and then carries the late rule's state from batch to
    batch; state and events of a batch are committed together. With the same checkpoint the query goes on where it stopped,
    with another one it is another run: it reads the log from its beginning and the bound keeps out what is stored.
    """
    run = run or store.run_of(checkpoint)
    restart_point(spark, target, run, checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if store.is_committed(session, target, batch_id, run, checkpoint):
            return
        state = store.read_batches(session, target, late.STATE_SCHEMA, "state", run, last=True)
        judged, end = late.late_data(op.parse_log(logs.with_line_order(batch)), logs.LINE_ORDER, state)
        kept = stage(judged.where("kept").select(*op.EVENT, "check", *logs.LINE_ORDER))
        rows = to_insert(session, kept, logs.LINE_ORDER, target)
        store.write_batch({"rows": rows, "state": end}, target, batch_id, run, checkpoint)

    drain(lines.writeStream.foreachBatch(step), checkpoint)


def late_rule(spark: SparkSession, lines: DataFrame, target: str, checkpoint: str, run: str | None = None) -> None:
    """The late rule alone over a stream: every row with its marks, and the state that the next batch goes on from."""
    run = run or store.run_of(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if store.is_committed(session, target, batch_id, run, checkpoint):
            return
        state = store.read_batches(session, target, late.STATE_SCHEMA, "state", run, last=True)
        judged, end = late.late_data(op.parse_log(logs.with_line_order(batch)), logs.LINE_ORDER, state)
        marks = judged.select(*op.EVENT, "kept", "late", "check")
        store.write_batch({"rows": marks, "state": end}, target, batch_id, run, checkpoint)

    drain(lines.writeStream.foreachBatch(step), checkpoint)
