import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyroom.functions import attendance as fn
from tallyroom.operators import attendance as op

READINGS = "event_id bigint, tagId string, time string, action int"


def stamp(seconds):
    return f"202401{1 + seconds // 86400:02d}{seconds // 3600 % 24:02d}{seconds // 60 % 60:02d}{seconds % 60:02d}"


def test_lookback_is_strict(spark):
    rows = spark.createDataFrame([(1, "a", "20240101115500", 1), (2, "b", "20240101115501", 2)], READINGS)
    at = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    assert [r.tagId for r in op.last_reading(rows, at).collect()] == ["b"]


def test_previous_reading_is_strict_and_crosses_ranges(spark):
    base = 3600 * 5
    rows = spark.createDataFrame([
        (1, "a", stamp(base - 1), 1), (2, "a", stamp(base + 298), 2), (3, "a", stamp(base + 598), 3)], READINGS)
    got = {r.event_id: r.prev_time for r in op.previous_reading(rows).collect()}
    assert got == {1: None, 2: stamp(base - 1), 3: None}


def test_uid_functions(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3, 4, 4]), (2, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4]), (4, [5, 74, 28, 185, 234])],
                                 "id int, uid array<int>")
    got = {r.id: r for r in op.card_match(rows).select(
        "id", "card", fn.uid_checksum(F.col("uid")).alias("ok"), fn.tag_id(F.col("uid")).alias("tag")).collect()}
    assert [got[i].ok for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert got[4].tag == "57428185234" and got[4].card == "Card A" and got[1].card == "wrong Card"


def test_owner_and_ascii(spark):
    readings = spark.createDataFrame([(1, "t", "20240101000000", 1), (2, "x", "20240101000000", 1)], READINGS)
    cards = spark.createDataFrame([("t", 7), ("t", 9)], "tagId string, userId bigint")
    users = spark.createDataFrame([(7, "Jiří", "Novák"), (9, "No", "One")], "id bigint, name string, surname string")
    got = {r.tagId: r.owner for r in op.reading_owner(readings, cards, users).collect()}
    assert got == {"t": "Novak, Jiri", "x": "Neznama karta"}
    folded = spark.range(1).select(fn.ascii_fold(F.lit("Щука їжак Ørsted ß 漢")).alias("f")).first().f
    assert folded == "Shchuka yizhak Orsted ss 漢"  # what has no ASCII form stays
    signs = spark.range(1).select(fn.ascii_fold(F.lit("Ωμέγα – „5 €“… Θεός ﬀ\u200b Ａ")).alias("f")).first().f
    assert signs == "Omega - \"5 EUR\"... Theos ﬀ\u200b A"


def test_voiding_matches_a_stack(spark):
    rng = random.Random(5)
    log, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 1, 20, 100, 200, 359, 360, 361, 700])
        log.append((i, rng.choice(["hot", "hot", "b"]), stamp(t), None if rng.random() < 0.4 else 1, t))
    gone, stacks = set(), {}
    for i, tag, _, action, at in log:
        stack = stacks.setdefault(tag, [])
        if action is not None:
            stack.append((i, at))
        elif stack and at - stack[-1][1] < 360:
            gone.add(stack.pop()[0])
    df = spark.createDataFrame([r[:4] for r in log], READINGS).withColumn("is_void", F.col("action").isNull())
    kept = {r.event_id for r in op.void_readings(df, width=720).collect()}
    assert kept == {r[0] for r in log if r[3] is not None} - gone
    assert gone


def test_void_once(spark):
    rows = spark.createDataFrame([(1, "a", "20240101115900", 1), (2, "a", "20240101115930", 2), (3, "b", "20240101115400", 1)], READINGS)
    asked = spark.createDataFrame([("a", "2024-01-01 12:00:00"), ("b", "2024-01-01 12:00:00")], "tagId string, at string") \
        .withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert {r.event_id for r in op.void_last_reading(rows, asked).collect()} == {1, 3}


def test_write_readings_appends(spark, tmp_path):
    taken = spark.sql("select 'a' tagId, timestamp_ntz'2024-01-01 10:00:00.9' ts, 1 action")
    for _ in range(2):
        op.write_readings(op.append_reading(taken), str(tmp_path / "readings"))
    assert [r.time for r in spark.read.parquet(str(tmp_path / "readings")).collect()] == ["20240101100000"] * 2


def test_running_equals_plain_windows_on_a_hot_key(spark):
    from tallyroom.operators.ordered import running
    rng = random.Random(1)
    rows = spark.createDataFrame(
        [("hot" if rng.random() < 0.8 else rng.choice("abc"), i, rng.choice([None, *range(50)])) for i in range(3000)],
        "k string, i bigint, v bigint")
    got = running(rows, ["k"], ["i"], F.floor(F.col("i") / 37).cast("bigint"), sums={"s": F.col("v")},
                  mins={"m": F.col("v")}, previous={"p": F.col("v")})
    w = Window.partitionBy("k").orderBy("i")
    want = rows.select("*", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.min("v").over(w).alias("m"), F.lag("v").over(w).alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
