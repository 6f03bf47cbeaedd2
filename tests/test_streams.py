"""Streams that stop, start again, fail half-way and meet late rows."""

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyroom.operators import events as op
from tallyroom.sources import growing, logs, store
from tallyroom.streaming import brokers, logs as streams

LINE = "namespace string, segment string, seq int, value string"


class Stop(Exception):
    pass


def pipeline(arrivals, stored=()):
    """Row by row: events ``(namespace, mailId, timestamp, message)`` in arrival order, a list of what is stored after them."""
    table, state = list(stored), {}
    for e in stored:
        bound, _ = state.get(e[0], ("", None))
        state[e[0]] = (max(bound, e[2]), None)
    for e in arrivals:
        bound, previous = state.get(e[0], (None, None))
        if bound is not None and e[2] < bound:
            continue
        if previous is not None and e[2] < previous:
            bound = e[2]
        state[e[0]] = (bound, e[2])
        if bound != e[2] or e not in table:
            table.append(e)
    return table


def arrivals(rng, n, spaces=("n", "m")):
    """Nearly ordered lines with copies, some of them right after the first."""
    out = []
    for i in range(n):
        stamp = f"2024-01-01 10:{(i // 8 + rng.randint(0, 3)) % 60:02d}:{rng.randint(0, 2) * 20:02d}"
        e = (rng.choice(spaces), "1AbCdE-0000Xx-Gf", stamp, rng.choice("abc"))
        out += [e] * (2 if rng.random() < 0.3 else 1)
    return out


def land(spark, folder, events, segment):
    lines = [(e[0], f"{segment:04d}", i, f"{e[2]} {e[1]} {e[3]}") for i, e in enumerate(events)] + [("n", f"{segment:04d}", -1, "junk")]
    logs.land_segments(spark.createDataFrame(lines, LINE), folder)


def stored_in(spark, target):
    return Counter(tuple(r) for r in store.read_batches(spark, target, op.EVENT_SCHEMA).select(*op.EVENT).collect())


def test_pipeline_stopped_and_started_equals_row_by_row(spark, tmp_path):
    rng = random.Random(6)
    events = arrivals(rng, 160)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(4):
        land(spark, folder, events[k * 60 : k * 60 + 60] if k < 3 else events[180:], k)
        streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
        assert stored_in(spark, target) == Counter(pipeline(events[: k * 60 + 60] if k < 3 else events))
    # Another run reads the log from its beginning: the bound keeps out what is stored.
    once = pipeline(events)
    streams.ingest(spark, logs.log_source(spark, folder), target, str(tmp_path / "other"))
    assert stored_in(spark, target) == Counter(pipeline(events, once))
    assert {r.batch for r in store.commits(spark, target).where(F.col("run") == store.run_of(checkpoint)).collect()} == {-1, 0, 1, 2, 3}


def test_a_line_a_day_late_stays(spark, tmp_path):
    events = [("n", "1AbCdE-0000Xx-Gf", f"2024-01-{d} 10:00:00", m) for d, m in (("03", "a"), ("02", "late"), ("02", "late"), ("01", "below"), ("03", "b"))]
    land(spark, str(tmp_path / "in"), events, 0)
    streams.ingest(spark, logs.log_source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [e[3] for e in sorted(stored_in(spark, str(tmp_path / "out")).elements())] == ["late", "a", "b"]


@pytest.mark.parametrize("when", ["write_attempt", "commit"])
def test_a_crash_before_or_after_the_write_is_made_good(spark, tmp_path, monkeypatch, when):
    """The query dies before the batch is written or between its write and its commit, and is started again."""
    rng = random.Random(9)
    events = arrivals(rng, 60)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    land(spark, folder, events[:40], 0)
    streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    land(spark, folder, events[40:], 1)
    real = getattr(store, when)

    def dies(*args, **kwargs):
        if when == "write_attempt":
            real(*args, **kwargs)
        raise Stop

    monkeypatch.setattr(store, when, dies)
    with pytest.raises(Exception):  # noqa: B017  the stream wraps it
        streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    assert stored_in(spark, target) == Counter(pipeline(events[:40]))
    monkeypatch.setattr(store, when, real)
    streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    assert stored_in(spark, target) == Counter(pipeline(events))


def test_a_lost_checkpoint_log_after_the_commit_writes_nothing_twice(spark, tmp_path):
    """The batch is committed in the store and the stream dies before it notes that: the batch comes again."""
    events = arrivals(random.Random(4), 50)
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    land(spark, folder, events, 0)
    streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    shutil.rmtree(f"{checkpoint}/commits")
    streams.ingest(spark, logs.log_source(spark, folder), target, checkpoint)
    assert stored_in(spark, target) == Counter(pipeline(events))


def test_two_ingestions_keep_all_rows_and_foreign_files_are_not_seen(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(k,) for k in x], "k int")
    assert store.read_batches(spark, target, "k int").count() == 0
    store.sink(target, "a", "here")(rows(1, 2), 0)
    store.sink(target, "b", "there")(rows(3), 0)
    store.sink(target, "a", "here")(rows(1, 2), 0)
    store.write_attempt({"rows": rows(9)}, target, 1, "a")
    rows(8).write.parquet(f"{target}/data/c/0/x/rows")
    rows(7).write.parquet(f"{target}/data/a/0/x/rows")
    assert sorted(r.k for r in store.read_batches(spark, target, "k int").collect()) == [1, 2, 3]
    assert sorted(r.k for r in store.read_batches(spark, target, "k int", run="b").collect()) == [3]
    with pytest.raises(store.OtherOrigin):
        store.sink(target, "a", "elsewhere")(rows(5), 0)
    with pytest.raises(ValueError):
        store.sink(target, "a/b")(rows(5), 0)
    attempt = store.write_attempt({"rows": rows(6)}, target, 0, "b")
    with pytest.raises(Exception):  # noqa: B017  the second of two writers
        store.commit(spark, target, 0, "b", attempt, "there")
    assert sorted(r.k for r in store.read_batches(spark, target, "k int").collect()) == [1, 2, 3]


def test_streamed_marks_equal_row_by_row(spark, tmp_path):
    rng = random.Random(3)
    stamps = [f"2024-01-01 10:{i // 4:02d}:{rng.randint(0, 59):02d}" for i in range(160)]
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in range(4):
        land(spark, folder, [("n", "1AbCdE-0000Xx-Gf", t, str(part * 40 + i)) for i, t in enumerate(stamps[part * 40 : part * 40 + 40])], part)
        if part % 2:
            streams.late_rule(spark, logs.log_source(spark, folder, max_files=1), target, checkpoint)
    got = store.read_batches(spark, target, op.EVENT_SCHEMA + ", kept boolean, late boolean, check boolean").collect()
    bound = previous = None
    for r in sorted(got, key=lambda r: int(r.message)):
        kept = bound is None or r.timestamp >= bound
        late = kept and previous is not None and r.timestamp < previous
        bound, previous = (r.timestamp if late else bound), (r.timestamp if kept else previous)
        assert (r.kept, r.late, r.check) == (kept, late, kept and r.timestamp == bound)
    assert len(got) == 160


def test_appended_lines_arrive_once_and_a_torn_line_waits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "PIECE", 16)  # far less than some lines; the driver's side
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in" / "n").mkdir(parents=True)
    path = tmp_path / "in" / "n" / "log"

    def run():
        lines = growing.growing_logs(spark, folder, range=10)
        streams.drain(lines.writeStream.foreachBatch(store.sink(target, "r", checkpoint)), checkpoint)
        return sorted((r.line_no, r.value) for r in store.read_batches(spark, target, growing.SCHEMA).where("namespace = 'n'").collect())

    path.write_bytes("one\n\nthrée is a line that spans ranges\r\ntor".encode())
    want = [(0, "one"), (4, ""), (5, "thrée is a line that spans ranges")]
    assert run() == want
    assert run() == want
    with path.open("ab") as f:
        f.write("n at first\nnext\nand ag".encode())
    want += [(len("one\n\nthrée is a line that spans ranges\r\n".encode()), "torn at first")]
    want += [(want[-1][0] + len("torn at first\n"), "next")]
    assert run() == want
    (tmp_path / "in" / "namespace=m").mkdir()
    (tmp_path / "in" / "namespace=m" / "log").write_bytes(b"other\n")
    with path.open("ab") as f:
        f.write(b"ain\n")
    assert run() == [*want, (want[-1][0] + len("next\n"), "and again")]
    assert [r.value for r in store.read_batches(spark, target, growing.SCHEMA).where("namespace = 'm'").collect()] == ["other"]


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_ranges_hold_each_line_once(tmp_path, width):
    rng = random.Random(width)
    lines = ["x" * rng.choice([0, 1, 2, 30]) for _ in range(80)]
    data = "".join(x + "\n" for x in lines).encode()
    (tmp_path / "f").write_bytes(data)
    system, path = growing.opened(str(tmp_path / "f"))
    for first in (0, data.index(b"\n") + 1):
        parts = [growing.ByteRange(path, "n", first, k, min(k + width, len(data)), len(data)) for k in range(first, len(data), width)]
        got = [x for p in parts for b in growing.lines_of(system, p) for x in b.column("value").to_pylist()]
        assert got == (lines if first == 0 else lines[1:])


def test_the_pipeline_follows_a_growing_file(spark, tmp_path):
    events = arrivals(random.Random(12), 60, spaces=("n",))
    folder, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in" / "n").mkdir(parents=True)
    for part in (events[:25], events[25:26], events[26:]):
        with (tmp_path / "in" / "n" / "mainlog").open("a") as f:
            f.writelines(f"{e[2]} {e[1]} {e[3]}\n" for e in part)
        streams.ingest(spark, growing.growing_logs(spark, folder, range=200), target, checkpoint)
    assert stored_in(spark, target) == Counter(pipeline(events))


def brute_periods(failures, seconds=60):
    out = []
    for p in {p for p, _ in failures}:
        for t in sorted(t for q, t in failures if q == p):
            if out and out[-1][0] == p and t < out[-1][2]:
                out[-1][2:] = [t + seconds, out[-1][3] + 1]
            else:
                out.append([p, t, t + seconds, 1])
    return sorted(map(tuple, out))


def test_exclusions_by_failures_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    failures = [(rng.randint(0, 2), rng.randint(0, 1500)) for _ in range(80)] + [(0, 100), (0, 160), (0, 220), (1, 5000), (0, 90_000)]
    rng.shuffle(failures)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(0, len(failures), 20):
        rows = spark.createDataFrame(failures[k : k + 20], "provider int, s int").selectExpr("provider", "timestamp_seconds(s) as fail_ts")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema("provider int, fail_ts timestamp").parquet(source)
        brokers.ban_state(spark, stream, target, checkpoint)
        now = brokers.exclusions(spark, target).selectExpr("provider", "unix_seconds(ban_start)", "unix_seconds(ban_end)", "n_failures").collect()
        assert sorted(tuple(r) for r in now) == brute_periods(failures[: k + 20])  # periods that still run are there
    newest = store.read_batches(spark, target, brokers.PERIOD).where("ban_end is null").count()
    assert newest > 0  # some period was joined by a later one


def test_changes_of_snapshots_and_the_buckets_they_rewrite(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id bigint, config map<string,string>, from string, version bigint"
    base = {k: {"a": str(k)} for k in range(40)}
    snapshots = [base, base | {3: {"a": "x"}, 40: {"a": "40"}}, base | {3: {"a": "x", "b": "1"}, 40: {"a": "40"}}, base | {3: {"a": "x"}, 40: {"a": "41"}}]

    def run(*versions):
        for v in versions:
            rows = [(i, c, "f", v) for i, c in snapshots[v].items()]
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(source)
        brokers.poll_changes(spark, spark.readStream.schema(schema).parquet(source), target, checkpoint, buckets=16)
        return sorted((r.version, r.id, r.drift) for r in store.read_batches(spark, target, brokers.CHANGE).collect())

    def index():
        rows = store.read_batches(spark, target, brokers.INDEX, "index", store.run_of(checkpoint), last=True).collect()
        return {r.bucket: r.path for r in rows}

    want = [(0, i, "new") for i in range(40)]
    assert run(0) == want
    first = index()
    want += [(1, 3, "changed"), (1, 40, "new")]  # the third only adds a field, which is no change
    assert run(1, 2) == want
    second = index()
    of = {r.id: r.b for r in spark.range(41).selectExpr("id", "pmod(hash(id), 16) as b").collect()}
    assert {k for k in second if second[k] != first.get(k)} == {of[3], of[40]}  # no other bucket is written again
    want += [(3, 40, "changed")]  # and giving it up again is none either, as it was never held
    assert run(3) == want
    spark.createDataFrame([(3, {"a": "out of date"}, "f", 2)], schema).write.mode("append").parquet(source)
    assert run() == want
