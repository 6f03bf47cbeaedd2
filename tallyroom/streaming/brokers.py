"""Provider exclusions and configuration changes as streaming queries that keep what they know in a committed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyroom.operators.mail import holds
from tallyroom.sources import store
from tallyroom.streaming.logs import drain
from tallyroom.workspace import stage

PERIOD = "provider int, ban_start timestamp, ban_end timestamp, n_failures bigint, version bigint"


def _latest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key, without those that were taken back."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("x")).select(*keys, "x.*")


def exclusions(spark: SparkSession, target: str) -> DataFrame:
    """The exclusion periods known so far: provider, ban_start, ban_end, n_failures. One that lies in the future still runs."""
    found = _latest(store.read_batches(spark, target, PERIOD), ["provider", "ban_start"])
    return found.where("ban_end is not null").drop("version")


def merged_periods(periods: DataFrame) -> DataFrame:
    """Periods ``(provider, ban_start, ban_end, n_failures)`` that overlap as one. One that starts at another's end is another."""
    before = Window.partitionBy("provider").orderBy("ban_start", "ban_end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("provider").orderBy("ban_start", "ban_end").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce((F.col("ban_start") >= F.max("ban_end").over(before)).cast("int"), F.lit(1))
    numbered = periods.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(upto))
    return numbered.groupBy("provider", "_island").agg(
        F.min("ban_start").alias("ban_start"), F.max("ban_end").alias("ban_end"), F.sum("n_failures").alias("n_failures")).drop("_island")


def ban_state(spark: SparkSession, failures: DataFrame, target: str, checkpoint: str, run: str | None = None, seconds: int = 60) -> None:
    """Exclusion periods of a stream ``(provider, fail_ts timestamp)``, written from their first failure on.

    The state is the store itself. A batch is cut to its own periods first, so a provider that fails all the time costs few
    rows; then the stored periods it can touch are read, which the files' statistics find, and only periods that came, grew or
    joined are written as new versions. A period that joins an earlier one is taken back by a version without an end.
    There is no watermark: a failure that arrives late, however late, grows, joins or opens a period like any other. A period is
    over by the clock of whoever reads it, so nothing has to be written when it ends.
    """
    run = run or store.run_of(checkpoint)

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if store.is_committed(session, target, batch_id, run, checkpoint):
            return
        end = F.col("fail_ts") + F.make_dt_interval(secs=F.lit(seconds))
        each = batch.groupBy("provider", "fail_ts").agg(F.count("*").alias("n_failures"))  # a row for each second at most
        new = merged_periods(each.select("provider", F.col("fail_ts").alias("ban_start"), end.alias("ban_end"), "n_failures"))
        low, high = batch.agg(F.min("fail_ts"), F.max(end)).first()
        if low is None:
            return
        # All versions of a period have its start; all but the last are shorter than the last.
        near = store.read_batches(session, target, PERIOD).where((F.col("ban_start") <= F.lit(high)) & (F.col("ban_end").isNull() | (F.col("ban_end") >= F.lit(low))))
        held = _latest(near, ["provider", "ban_start"]).where("ban_end is not null").drop("version")
        now = merged_periods(new.unionByName(held))
        was = held.select("provider", "ban_start", F.col("n_failures").alias("_n"))
        both = now.join(was, ["provider", "ban_start"], "full")
        changed = both.where(~F.col("n_failures").eqNullSafe(F.col("_n")))  # a period that takes in a failure counts one more
        version = store.commits(session, target).count()
        rows = changed.select("provider", "ban_start", "ban_end", "n_failures", F.lit(version).cast("bigint").alias("version"))
        store.write_batch({"rows": rows}, target, batch_id, run, checkpoint)

    drain(failures.writeStream.foreachBatch(step), checkpoint)


HELD = "id bigint, config map<string,string>, `from` string"
CHANGE = "id bigint, drift string, version bigint"
INDEX = "bucket int, path string, seen bigint"
_LOG = "array<struct<drift:string,version:bigint>>"


def _followed(held: Column, row: Column) -> Column:
    """What is held after one more row: it is replaced only by a row that does not keep it, as extra fields are no change."""
    config = F.map_from_entries(row["entries"])
    drift = F.when(~held["known"], F.lit("new")).when(~holds(held["config"], held["from"], config, row["from"]), F.lit("changed"))
    take = lambda new, old: F.when(drift.isNotNull(), new).otherwise(old)
    return F.struct(
        F.lit(True).alias("known"), take(config, held["config"]).alias("config"), take(row["from"], held["from"]).alias("from"),
        take(F.concat(held["log"], F.array(F.struct(drift.alias("drift"), row["version"].alias("version")))), held["log"]).alias("log"))


def poll_changes(spark: SparkSession, snapshots: DataFrame, target: str, checkpoint: str, run: str | None = None, buckets: int = 64) -> None:
    """Report ids created or replaced by each snapshot of a stream ``(id, config, from, version)``.

    ``version`` numbers the snapshots, so any number of files may hold one, and a batch may bring parts of several. What is
    held lies in buckets by id. A batch reads the buckets its ids fall into, follows each id through the versions it
    brings, and writes only the buckets in which something was created or replaced; an index goes with each commit and
    points at the newest copy of each bucket. Rows of a snapshot older than the newest one seen in their bucket are out of date.
    """
    run = run or store.run_of(checkpoint)
    bucket = F.pmod(F.hash("id"), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if store.is_committed(session, target, batch_id, run, checkpoint):
            return
        index = {r["bucket"]: (r["path"], r["seen"]) for r in store.read_batches(session, target, INDEX, "index", run, last=True).collect()}
        known = session.createDataFrame([(k, seen) for k, (_, seen) in index.items()], "bucket int, seen bigint")  # at most ``buckets`` rows
        new = batch.withColumn("bucket", bucket).join(F.broadcast(known), "bucket", "left").where("seen is null or version >= seen")
        new = stage(new.select("bucket", "id", F.col("version").cast("bigint").alias("version"), F.map_entries("config").alias("entries"), "from"))
        seen = {r["bucket"]: r["seen"] for r in new.groupBy("bucket").agg(F.max("version").alias("seen")).collect()}
        paths = [index[k][0] for k in sorted(set(seen) & set(index))]
        held = session.read.schema(HELD).parquet(*paths) if paths else session.createDataFrame([], HELD)
        steps = new.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("version", "entries", "from"))).alias("rows"))  # a row for each version
        both = held.withColumn("known", F.lit(True)).join(steps, "id", "full")
        before = F.struct(F.coalesce("known", F.lit(False)).alias("known"), "config", "from", F.array().cast(_LOG).alias("log"))
        now = stage(both.select("id", bucket.alias("bucket"), F.aggregate(F.coalesce("rows", F.array().cast(steps.schema["rows"].dataType)), before, _followed).alias("x")))
        changes = now.select("id", F.explode("x.log").alias("c")).select("id", "c.drift", "c.version")
        moved = sorted(r["bucket"] for r in now.where(F.size("x.log") > 0).select("bucket").distinct().collect())
        attempt = store.write_attempt({"rows": changes}, target, batch_id, run)
        root = f"{target}/data/{run}/{batch_id}/{attempt}"
        (now.where(F.col("bucket").isin(moved)).select("bucket", "id", "x.config", "x.from").repartition("bucket")
         .write.partitionBy("bucket").parquet(f"{root}/held"))
        newest = {k: (path, max(v, seen.get(k, v))) for k, (path, v) in index.items()} | {k: (f"{root}/held/bucket={k}", seen[k]) for k in moved}
        session.createDataFrame([(k, *x) for k, x in sorted(newest.items())], INDEX).coalesce(1).write.parquet(f"{root}/index")
        store.commit(session, target, batch_id, run, attempt, checkpoint)

    drain(snapshots.writeStream.foreachBatch(step), checkpoint)
