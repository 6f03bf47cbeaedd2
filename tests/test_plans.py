"""Plans of lazily built queries: what must and must not be in them."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyroom.operators import lookup, ordered
from tallyroom.plans import catalog

D = "/root/testdata/sf0.001"
LAZY = [
    "scan_filter_eq", "reading_owner", "card_match", "last_reading", "last_reading_as_of", "void_last_reading", "latest_one",
    "inline_rows", "distinct_row_ids", "pending_recipients", "batch_chunks", "render_message", "stop_batch_on_failure", "delivery_state",
    "task_progress", "provider_ban", "config_drift", "mime_plan", "parse_log", "since_watermark", "event_not_seen", "out_of_order",
    "ban_periods", "cell_json", "sheet_rows", "split_questions", "question_type", "known_type",
]


def plan_of(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return catalog.QUERIES[name](spark, D)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", LAZY)
def test_nothing_is_crossed_or_gathered(spark, name):
    plan = plan_of(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython", "ArrowEvalPython", "InPandas"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", ["sheet_rows", "row_all_blank", "drop_leading"])
def test_rows_of_sheets_are_not_gathered_for_a_broadcast(spark, name):
    """What the cells unfold to is not in Spark's estimate."""
    plan = plan_of(spark, name).split("== Physical Plan ==")[1]
    assert not re.search(r"BroadcastHashJoin \[workbook_id#\d+, (row_idx|q_seq)", plan) and "SortMergeJoin [workbook_id" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(spark, "scan_filter_eq")
    assert "EqualTo(p_brand,Brand#7)" in plan and "p_retailprice" not in plan.split("== Physical Plan ==")[1]


def test_ranges_of_readings_need_one_shuffle(spark):
    assert plan_of(spark, "last_reading").split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
    assert plan_of(spark, "void_last_reading").split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_latest_reading_is_combined_before_the_shuffle(spark):
    assert "partial_max_by" in plan_of(spark, "latest_one")


@pytest.mark.parametrize("name", ["since_watermark", "event_not_seen"])
@pytest.mark.parametrize("measured", [True, False])
def test_no_event_is_shuffled_by_its_namespace_alone(spark, monkeypatch, name, measured):
    """Whatever Spark's own limit: a small table is measured and broadcast, a large one meets rows that are salted."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 10**6 if measured else 0)
    try:
        plan = plan_of(spark, name).split("== Physical Plan ==")[1]
        got = sorted(map(str, catalog.QUERIES[name](spark, D).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange hashpartitioning\(namespace#\d+, \d+\)", plan)
    assert ("BroadcastHashJoin [namespace" in plan) == measured and ("_salt" in plan) != measured
    monkeypatch.undo()
    assert got == sorted(map(str, catalog.QUERIES[name](spark, D).collect()))


def test_lookups_give_the_same_joins_salted_or_not(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "case when id % 3 = 0 then null when id < 150 then 'hot' else cast(id as string) end as k")
    small = spark.createDataFrame([("hot", 1), ("160", 2), ("161", 3), (None, 4)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        found = []
        for limit in (10**6, 0):
            monkeypatch.setattr(lookup, "BROADCAST_BYTES", limit)
            df = lookup.lookup(rows, small, ["k"], how)
            found.append((df.columns, sorted(map(str, df.collect()))))
        assert found[0] == found[1] == (df.columns, sorted(map(str, rows.join(small, "k", how).collect())))


@pytest.mark.parametrize("name, scans", [("out_of_order", 2), ("batch_chunks", 4), ("split_questions", 1)])
def test_running_windows_evaluate_their_input_once(spark, name, scans):
    """The summary of ranges reads the shuffle of the rows again. Ranges of arrivals take one narrow scan for the sketch; pending
    rows come from four tables."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    spark.sparkContext.setJobGroup("building", name)
    try:
        plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) - before
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.sparkContext.setJobGroup("rest", "rest")
    assert plan.count("FileScan") == scans and "ReusedExchange" in plan
    assert jobs <= scans  # reading the schema of a table is a job of its own


def test_a_burst_is_cut_like_the_rest(spark):
    """Nine of ten rows in one second of a day: ranges by quantiles hold about as many rows each."""
    rows = spark.range(10_000).selectExpr("'n' as k", "id", "case when id % 10 = 0 then id * 8640000 else 43200000000 + id * 100 end as at")
    cut = ordered.with_ranges(rows, ["k"], F.col("at"), ranges=50)
    sizes = [r.n for r in cut.groupBy("_bucket").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 45 and max(sizes) <= 500
    got = ordered.running(cut, ["k"], ["at", "id"], None, sums={"n": F.lit(1)}, previous={"before": F.col("id")}, once=True)
    by = Window.partitionBy("k").orderBy("at", "id")
    want = rows.withColumn("n", F.row_number().over(by).cast("bigint")).withColumn("before", F.lag("id").over(by))
    assert sorted(map(tuple, got.select("id", "n", "before").collect())) == sorted(map(tuple, want.select("id", "n", "before").collect()))
