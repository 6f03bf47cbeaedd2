"""Mail-server log queries, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.operators import events as op, late
from tallyroom.plans import binding as b
from tallyroom.sources import growing, logs, store
from tallyroom.streaming import brokers, logs as streams
from tallyroom.workspace import new_folder

STORED_BEFORE = "2024-01-16"
ORDER = ["seq", "event_id"]


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return op.parse_log(b.log_lines(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where(F.col("timestamp") < STORED_BEFORE).select(*op.EVENT)


def parse_log(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


def max_ts_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    return op.max_ts_by_namespace(_parsed(spark, d))


def since_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The whole log read again against a half-filled store."""
    last = op.max_ts_by_namespace(_stored(spark, d))
    return op.since_watermark(_parsed(spark, d), last)


def event_not_seen(spark: SparkSession, d: str) -> DataFrame:
    stored = _stored(spark, d)
    last = op.max_ts_by_namespace(stored)
    return op.event_not_seen(op.since_watermark(_parsed(spark, d), last), stored, last)


def out_of_order(spark: SparkSession, d: str) -> DataFrame:
    return op.out_of_order(_parsed(spark, d).select("namespace", *ORDER, "timestamp"), ORDER).select(
        "namespace", "event_id", "timestamp", "previous")


def late_data(spark: SparkSession, d: str) -> DataFrame:
    judged, _ = late.late_data(_parsed(spark, d), ORDER)
    return judged.select("namespace", "event_id", "timestamp", "kept", "late", "check")


def ban_periods(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return op.ban_periods(b.failures(spark, d)).select("provider", stamp("ban_start"), stamp("ban_end"))


def _landed(spark: SparkSession, d: str, lines: DataFrame | None = None) -> str:
    folder = new_folder(spark, "segments")
    logs.land_segments(b.log_segments(b.log_lines(spark, d) if lines is None else lines), folder)
    return folder


def log_source(spark: SparkSession, d: str) -> DataFrame:
    """A folder of files that goes on growing while one query is stopped and started again."""
    folder, target, checkpoint = (new_folder(spark, n) for n in ("files", "lines", "checkpoint"))
    lines = b.log_segments(b.log_lines(spark, d))
    half = F.col("event_id") % 2 == 0
    for part in (half, ~half):
        logs.land_segments(lines.where(part), folder)
        stream = growing.growing_logs(spark, folder).select("namespace", "value")
        streams.drain(stream.writeStream.foreachBatch(store.sink(target, "lines", checkpoint)), checkpoint)
    return store.read_batches(spark, target, "namespace string, value string")


def event_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two ingestions into one table, each from batch 0; a batch that was written and not committed, and one delivered again."""
    target = new_folder(spark, "events")
    parsed = _parsed(spark, d)
    early, odd = F.col("timestamp") < STORED_BEFORE, F.col("event_id") % 2 == 1
    first, second = store.sink(target, "first", columns=op.EVENT), store.sink(target, "second", columns=op.EVENT)
    store.write_attempt({"rows": parsed.select(*op.EVENT)}, target, 0, "first")
    for batch_id, rows in [(0, parsed.where(early & odd)), (0, parsed.where(early & odd)), (1, parsed.where(early & ~odd))]:
        first(rows, batch_id)
    second(parsed.where(~early), 0)
    return store.read_batches(spark, target, op.EVENT_SCHEMA)


def _in_two_parts(spark: SparkSession, lines: DataFrame, target: str) -> DataFrame:
    """The log pipeline stopped after the first half of the segments and started again on the whole log."""
    folder, checkpoint = new_folder(spark, "segments"), new_folder(spark, "checkpoint")
    cut = b.log_segments(lines)
    low, high = cut.agg(F.min("segment"), F.max("segment")).first()
    half = f"{(int(low) + int(high)) // 2:0{len(high)}d}"
    for part in (F.col("segment") <= half, F.col("segment") > half):
        logs.land_segments(cut.where(part), folder)
        streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    return store.read_batches(spark, target, op.EVENT_SCHEMA)


def stream_log_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _in_two_parts(spark, b.log_lines(spark, d), new_folder(spark, "events"))


def restart_point(spark: SparkSession, d: str) -> DataFrame:
    """A store holding the first half, then a new run over the whole log."""
    target = new_folder(spark, "events")
    store.write_batch({"rows": _stored(spark, d)}, target, 0, "seed")
    return _in_two_parts(spark, b.log_lines(spark, d), target)


def backpressure_batch(spark: SparkSession, d: str) -> DataFrame:
    target, checkpoint = new_folder(spark, "events"), new_folder(spark, "checkpoint")
    parsed = op.parse_log(logs.log_source(spark, _landed(spark, d), 8))
    streams.drain(parsed.writeStream.foreachBatch(store.sink(target, "all", checkpoint, op.EVENT)), checkpoint)
    return store.read_batches(spark, target, op.EVENT_SCHEMA)


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every line delivered twice in a row: the second copy goes where the first one is the bound."""
    lines = b.log_lines(spark, d)
    twice = lines.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return _in_two_parts(spark, twice, new_folder(spark, "events"))


def late_data_stream(spark: SparkSession, d: str) -> DataFrame:
    target = new_folder(spark, "late")
    streams.late_rule(spark, logs.log_source(spark, _landed(spark, d)), target, new_folder(spark, "checkpoint"))
    return store.read_batches(spark, target, f"{op.EVENT_SCHEMA}, kept boolean, late boolean, check boolean")


def ban_state(spark: SparkSession, d: str) -> DataFrame:
    """Failures in three batches that are out of order; periods that still run at the newest failure are there too."""
    source, target, checkpoint = (new_folder(spark, n) for n in ("failures", "bans", "checkpoint"))
    rows = b.failures(spark, d).select("provider", F.col("fail_ts").cast("timestamp")).withColumn("part", F.pmod(F.xxhash64("provider", "fail_ts"), F.lit(3)))
    for part in range(3):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        failures = spark.readStream.schema("provider int, fail_ts timestamp").parquet(source)
        brokers.ban_state(spark, failures, target, checkpoint)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    newest = b.failures(spark, d).agg(F.max("fail_ts").cast("timestamp").alias("clock"))  # one row
    return brokers.exclusions(spark, target).join(F.broadcast(newest)).select(
        "provider", stamp("ban_start"), stamp("ban_end"), "n_failures", (F.col("ban_end") > F.col("clock")).alias("running"))


def poll_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots in files of any number, the second read after a restart."""
    source, target, checkpoint = (new_folder(spark, n) for n in ("snapshots", "changes", "checkpoint"))
    for version, snapshot in enumerate(b.config_snapshots(spark, d)):
        snapshot.select("id", "config", "from", F.lit(version).cast("bigint").alias("version")).repartition(4).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, config map<string,string>, from string, version bigint").parquet(source)
        brokers.poll_changes(spark, stream, target, checkpoint)
    return store.read_batches(spark, target, brokers.CHANGE).withColumn("version", F.col("version").cast("int"))


QUERIES = {f.__name__: f for f in [
    parse_log, max_ts_by_namespace, since_watermark, event_not_seen, out_of_order, late_data,
    ban_periods, log_source, event_sink, stream_log_ingest, restart_point, backpressure_batch,
    stream_dedup, late_data_stream, ban_state, poll_changes,
]}


def _with(body: str, ctes: str = "", recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{b.EVENTS_SQL}{ctes} {body}"


_PLAIN = 'select namespace, "mailId", timestamp, message from parsed'

_LATE = """,
 numbered as materialized (select *, row_number() over (partition by namespace order by seq, event_id) as rn from parsed),
 walk as (
   select namespace, event_id, rn, timestamp, cast(null as varchar) as bound, timestamp as previous,
     true as kept, false as late from numbered where rn = 1
   union all
   select n.namespace, n.event_id, n.rn, n.timestamp,
     case when n.timestamp >= coalesce(w.bound, '') and n.timestamp < w.previous then n.timestamp else w.bound end,
     case when n.timestamp >= coalesce(w.bound, '') then n.timestamp else w.previous end,
     n.timestamp >= coalesce(w.bound, ''),
     n.timestamp >= coalesce(w.bound, '') and n.timestamp < w.previous
   from walk w join numbered n on n.namespace = w.namespace and n.rn = w.rn + 1)
"""

# The pipeline: a kept row at the bound is stored only if it is the first of its kind and was not stored before.
_PIPELINE = """,
 numbered as materialized (select *, row_number() over (partition by namespace order by seq, event_id, copy) as rn from arrivals),
 walk as (
   select n.namespace, rn, event_id, timestamp, l.last as bound, case when l.last is null or n.timestamp >= l.last then n.timestamp end as previous,
     l.last is null or n.timestamp >= l.last as kept from numbered n left join begin l on l.namespace = n.namespace where rn = 1
   union all
   select n.namespace, n.rn, n.event_id, n.timestamp,
     case when n.timestamp >= coalesce(w.bound, '') and n.timestamp < w.previous then n.timestamp else w.bound end,
     case when n.timestamp >= coalesce(w.bound, '') then n.timestamp else w.previous end,
     n.timestamp >= coalesce(w.bound, '')
   from walk w join numbered n on n.namespace = w.namespace and n.rn = w.rn + 1),
 kept as (select p.namespace, p."mailId", w.timestamp, p.message, coalesce(w.timestamp = bound, false) as at_bound,
     row_number() over (partition by p.namespace, p."mailId", w.timestamp, p.message order by rn) as place
   from walk w join parsed p on p.event_id = w.event_id where w.kept),
 inserted as (select k.namespace, k."mailId", k.timestamp, k.message from kept k where not at_bound or place = 1 and not exists (
   select 1 from held h where h.namespace = k.namespace and h."mailId" = k."mailId" and h.timestamp = k.timestamp and h.message = k.message))
"""


def _pipeline(copies: int = 1, seeded: bool = False) -> str:
    begin = f""",
 arrivals as (select p.*, copy from parsed p, range({copies}) c(copy)),
 held as (select * from stored where {str(seeded).lower()}),
 begin as (select * from last where {str(seeded).lower()})"""
    seed = 'select namespace, "mailId", timestamp, message from held union all ' if seeded else ""
    return _with(f"{seed}select * from inserted", begin + _PIPELINE, True)


_SESSIONS = """
 gaps as (select provider, fail_ts, case when fail_ts < lag(fail_ts) over w + interval 60 second then 0 else 1 end as opens
   from failures window w as (partition by provider order by fail_ts)),
 grouped as (select *, sum(opens) over (partition by provider order by fail_ts rows unbounded preceding) as s from gaps),
 sessions as (select provider, min(fail_ts) as a, max(fail_ts) + interval 60 second as z, count(*) as n
   from grouped group by provider, s)
"""
_FAILURES = """with failures as (select cast(user_id % 5 as int) as provider, date_trunc('second', ts) as fail_ts
   from events where event_type = 'error'),"""

ORACLES = {
    "parse_log": _with("select * from parsed"),
    "max_ts_by_namespace": _with("select namespace, max(timestamp) as last from parsed group by 1"),
    "since_watermark": _with("select p.* from parsed p left join last l on l.namespace = p.namespace where l.last is null or l.last <= p.timestamp"),
    "event_not_seen": _with("""
      select p.namespace, p."mailId", p.timestamp, p.message from parsed p join last l on l.namespace = p.namespace
      where p.timestamp > l.last or p.timestamp = l.last and not exists (select 1 from stored s
        where s.namespace = p.namespace and s."mailId" = p."mailId" and s.timestamp = p.timestamp and s.message = p.message)"""),
    "out_of_order": _with("""
      select namespace, event_id, timestamp, lag(timestamp) over w as previous from parsed
      window w as (partition by namespace order by seq, event_id) qualify timestamp < lag(timestamp) over w"""),
    "late_data": _with("""select namespace, event_id, timestamp, kept, late,
        kept and coalesce(timestamp = bound, false) as "check" from walk""", _LATE, True),
    "late_data_stream": _with("""select w.namespace, p."mailId", w.timestamp, p.message, kept, late,
        kept and coalesce(w.timestamp = bound, false) as "check" from walk w join parsed p on p.event_id = w.event_id""", _LATE, True),
    "ban_periods": f"""{_FAILURES} {_SESSIONS} select provider, strftime(a, '%Y-%m-%d %H:%M:%S') as ban_start,
        strftime(z, '%Y-%m-%d %H:%M:%S') as ban_end from sessions""",
    "log_source": _with("""select namespace, case when junk then 'junk ' || props
        else timestamp || ' ' || "mailId" || ' ' || message end as value from lines"""),
    "event_sink": _with(_PLAIN),
    "stream_log_ingest": _pipeline(),
    "restart_point": _pipeline(seeded=True),
    "backpressure_batch": _with(_PLAIN),
    "stream_dedup": _pipeline(copies=2),
    "ban_state": f"""{_FAILURES} {_SESSIONS} select provider, strftime(a, '%Y-%m-%d %H:%M:%S') as ban_start,
        strftime(z, '%Y-%m-%d %H:%M:%S') as ban_end, n as n_failures,
        z > (select max(fail_ts) from failures) as running from sessions""",
    "poll_changes": """
      with e as (select user_id as id, props, event_type as f,
          row_number() over (partition by user_id order by event_id) as up,
          row_number() over (partition by user_id order by event_id desc) as down from events),
        held as (select id, json_extract_string(props, '$.k') as k, f from e where up = 1 and id % 10 <> 0),
        new as (select id, json_extract_string(props, '$.k') as k, f from e
          where (id % 3 = 0 and up = 1 or id % 3 <> 0 and down = 1) and id % 10 <> 1)
      select id, 'new' as drift, 0 as version from held
      union all select n.id, case when h.id is null then 'new' else 'changed' end, 1
        from new n left join held h on h.id = n.id where h.id is null or h.k <> n.k or h.f <> n.f""",
}
