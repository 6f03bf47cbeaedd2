import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyroom.operators import events as op, late

ARRIVALS = "namespace string, seq bigint, timestamp string"


def walk(stamps, bound=None, previous=None):
    out = []
    for t in stamps:
        if bound is not None and t < bound:
            out.append((False, False))
            continue
        late = previous is not None and t < previous
        bound, previous = (t if late else bound), t
        out.append((True, late))
    return out, bound, previous


def test_parse(spark):
    lines = spark.createDataFrame([("n", "2016-11-01 10:00:00 1AbCdE-0000Xx-Gf => bob@x"), ("n", "junk"), ("n", "x2016-11-01 10:00:00 1AbCdE-0000Xx-Gf y")],
                                  "namespace string, value string")
    assert [tuple(r) for r in op.parse_log(lines).collect()] == [("n", "1AbCdE-0000Xx-Gf", "2016-11-01 10:00:00", "=> bob@x")]


def test_late_rule(spark):
    rows = spark.createDataFrame([("n", i, f"2024-01-01 {t}:00") for i, t in enumerate(["10:00", "10:05", "10:03", "10:01"])], ARRIVALS)
    judged, end = late.late_data(rows, ["seq"])
    got = [(r.kept, r.late, r.check) for r in judged.orderBy("seq").collect()]
    assert got == [(True, False, False), (True, False, False), (True, True, True), (False, False, False)]
    assert [r.bound for r in end.collect()] == ["2024-01-01 10:03:00"]


def random_walks(rng):
    """Arrivals that are nearly in order, in disorder, falling, rising, all alike, and with one stamp far ahead."""
    near = [f"{i // 2 + rng.randint(0, 12):06d}" for i in range(300)]
    return {
        "near": near, "wild": [f"{rng.randint(0, 300):06d}" for _ in range(200)], "down": [f"{999 - i:06d}" for i in range(60)],
        "up": [f"{i:06d}" for i in range(130)], "same": ["000005"] * 50, "glitch": ["999999", *near[:150]], "one": ["000003"],
    }


@pytest.mark.parametrize("block, at_once", [(1, 50), (7, 50), (16, 10_000), (1024, 10_000)])
def test_late_rule_is_exact_over_blocks_and_batches(spark, monkeypatch, block, at_once):
    monkeypatch.setattr(late, "BLOCK", block)
    monkeypatch.setattr(late, "AT_ONCE", at_once)
    rng = random.Random(block)
    walks = random_walks(rng)
    start = {"near": ("000020", None), "up": ("000100", "000120"), "gone": ("000001", "000002"), "wild": (None, "000150")}
    want, ends, rows = {}, {"gone": start["gone"]}, []
    for ns, stamps in walks.items():
        marks, *ends[ns] = walk(stamps, *start.get(ns, (None, None)))
        want |= {(ns, i): m for i, m in enumerate(marks)}
        rows += [(ns, i, t) for i, t in enumerate(stamps)]
    df = spark.createDataFrame(rows, ARRIVALS)
    state = spark.createDataFrame([(k, *v) for k, v in start.items()], late.STATE_SCHEMA)
    first, state = late.late_data(df.where("seq < 100"), ["seq"], state)
    second, end = late.late_data(df.where("seq >= 100"), ["seq"], state)
    got = {(r.namespace, r.seq): (r.kept, r.late) for r in first.unionByName(second).collect()}
    assert got == want
    assert {r.namespace: (r.bound, r.previous) for r in end.collect()} == {k: tuple(v) for k, v in ends.items()}


def test_marking_goes_on_over_batches():
    rng = random.Random(2)
    stamps = [f"{i + rng.randint(0, 9):04d}" for i in range(90)]
    marks, _, _ = walk(stamps, "0004", "0006")
    table = pa.record_batch({"namespace": ["n"] * 90, "_block": [3] * 90, "timestamp": stamps, "_bound": ["0004"] * 90, "_previous": ["0006"] * 90})
    parts = [table.slice(k, 13) for k in range(0, 90, 13)]
    got = [(k, x) for b in late._judged(iter(parts), ["timestamp"]) for k, x in zip(b.column("kept").to_pylist(), b.column("late").to_pylist())]
    assert got == marks


def test_blocks_are_summed_up_in_bounded_runs(monkeypatch):
    """A block comes in pieces over several batches, and a long block among short ones makes no grid of its height for all."""
    monkeypatch.setattr(late, "AT_ONCE", 2000)
    rng = random.Random(4)
    blocks = [[f"{rng.randint(0, 999):03d}" for _ in range(1024 if k % 90 == 0 else rng.randint(1, 3))] for k in range(400)]
    pieces = [(k, b[i : i + late.PIECE]) for k, b in enumerate(blocks) for i in range(0, len(b), late.PIECE)]
    batch = lambda rows: pa.RecordBatch.from_arrays(
        [pa.array(["n"] * len(rows)), pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.string())),
         pa.array([None] * len(rows), pa.string()), pa.array(["999"] * len(rows))], ["namespace", "_block", "stamps", "low", "high"])
    grid, cells = late._grid, []
    monkeypatch.setattr(late, "_grid", lambda codes, sizes: cells.append(max(sizes) * len(sizes)) or grid(codes, sizes))
    got = [r for out in late._summaries(batch(pieces[k : k + 50]) for k in range(0, len(pieces), 50)) for r in out.to_pylist()]
    assert [(r["_block"], r["greatest"]) for r in got] == [(k, max(b)) for k, b in enumerate(blocks)]
    assert [[c["stamp"] for c in r["entry"]] for r in got] == [[t for i, t in enumerate(b) if t > max(b[:i], default="")] for b in blocks]
    assert max(cells) <= 2000


def test_late_rule_takes_the_same_jobs_for_any_log(spark):
    """Two tables are written, whatever the arrivals; nothing waits for what a block says."""
    tracker, seen = spark.sparkContext.statusTracker(), []
    for k, stamps in enumerate((["1"] * 10, [f"{9999 - i:05d}" for i in range(3000)], [f"{i % 97:05d}" for i in range(5000)])):
        spark.sparkContext.setJobGroup(f"late-{k}", "late")
        late.late_data(spark.createDataFrame([("n", i, t) for i, t in enumerate(stamps)], ARRIVALS), ["seq"])
        seen.append(len(tracker.getJobIdsForGroup(f"late-{k}")))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(set(seen)) == 1 and seen[0] <= 12, seen


def test_replay_of_the_boundary_second(spark):
    event = ("n", "1AbCdE-0000Xx-Gf", "2024-01-01 10:00:00", "m")
    other = ("n", "1AbCdE-0000Xx-Gg", "2024-01-01 10:00:00", "m")
    later = ("n", "1AbCdE-0000Xx-Gf", "2024-01-01 10:00:01", "m")
    stored = spark.createDataFrame([event], op.EVENT_SCHEMA)
    new = spark.createDataFrame([event, event, other, other, later, later], op.EVENT_SCHEMA)
    last = op.max_ts_by_namespace(stored)
    got = sorted(tuple(r) for r in op.event_not_seen(op.since_watermark(new, last), stored, last).collect())
    assert got == sorted([other, later, later])


def test_ban_periods_end_after_the_last_failure(spark):
    rows = spark.sql("""select 1 provider, timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, s) fail_ts
                        from values (0), (59), (59), (119), (118) t(s)""")
    got = [(str(r.ban_start)[11:], str(r.ban_end)[11:]) for r in op.ban_periods(rows).orderBy("ban_start").collect()]
    assert got == [("10:00:00", "10:02:59")]
    apart = spark.sql("select 1 provider, timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, s) fail_ts from values (0), (60) t(s)")
    assert op.ban_periods(apart).count() == 2
