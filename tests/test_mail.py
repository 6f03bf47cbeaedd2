import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyroom.functions import mail as fn
from tallyroom.operators import mail as op
from tallyroom.operators import registry
from tallyroom.sources import keyed, store
from tallyroom.sources.tables import update_by_id
from tallyroom.streaming import inbox

IDS = "taskId int, rowId string"


def test_null_state_is_pending(spark):
    ids = spark.createDataFrame([(1, x) for x in "abcd"], IDS)
    log = spark.createDataFrame([(1, "a", None), (1, "b", "failed-to-send"), (1, "c", "queued"), (1, "d", "exception")],
                                IDS + ", providerState string")
    pending = {r.rowId for r in op.pending_recipients(ids, log).collect()}
    sent = {r.rowId for r in op.sent_ids(log).collect()}
    assert pending == {"a", "b"} and pending | sent == set("abcd") and not pending & sent


def test_last_row_wins_and_address_stands_in_for_the_id(spark):
    data = '{"dataset":{"kind":"inline","rows":[{"id":"x","address":"1"},{"id":"x","address":"2"},{"id":"","address":"3"},{"address":"4"}]}}'
    tasks = spark.createDataFrame([(1, data)], "id int, data string")
    got = {r.rowId: r.row["address"] for r in op.distinct_row_ids(op.inline_rows(tasks)).collect()}
    assert got == {"x": "2", "3": "3", "4": "4"}


def test_chunks(spark):
    pending = spark.createDataFrame([(1, f"r{i}") for i in range(23)] + [(2, "one")], IDS)
    got = op.batch_chunks(pending).groupBy("taskId", "batch_no").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()
    assert sorted((r.taskId, r.batch_no, r.n, r.m) for r in got) == [(1, 0, 10, 9), (1, 1, 10, 9), (1, 2, 3, 2), (2, 0, 1, 0)]


def test_ban_end(spark):
    providers = spark.createDataFrame([(1,)], "id int")
    failed = spark.sql("select 1 provider, timestamp_ntz'2024-01-01 10:00:00' fail_ts")
    free = lambda at: op.provider_ban(providers, failed, F.lit(at).cast("timestamp_ntz")).count()
    assert [free(f"2024-01-01 {t}") for t in ("09:59:59", "10:00:00", "10:00:59", "10:01:00")] == [1, 0, 0, 1]


def test_batch_stops(spark):
    tries = spark.createDataFrame([(1, 0, i, i == 1) for i in range(4)] + [(1, 1, 0, False)],
                                  "taskId int, batch_no int, seq int, failed boolean")
    got = {(r.batch_no, r.seq) for r in op.stop_batch_on_failure(tries).collect()}
    assert got == {(0, 0), (0, 1), (1, 0)}


def test_delivery_states(spark):
    cases = [
        (1, "250 OK id=1aB-2", None, None, None, None), (2, None, None, None, None, None), (3, "nope", None, None, None, None),
        (4, None, None, "boom", "provider", None), (5, None, None, "boom", "worker", None), (6, None, "soft", None, None, "sent"),
        (7, "a==b", None, None, None, None), (8, "id=", None, None, None, None)]
    df = spark.createDataFrame(cases, "attempt_id int, response string, error string, exception string, raised_by string, state string")
    got = {r.attempt_id: r for r in op.delivery_state(df).collect()}
    assert [(got[i].providerMessageId, got[i].providerState) for i in range(1, 9)] == [
        ("1aB-2", "queued"), ("", None), (None, "failed-to-send"), (None, "failed-to-send"), (None, "exception"),
        ("", "sent"), ("", None), (None, "failed-to-send")]
    assert got[3].response_unparsed and not got[1].response_unparsed
    assert got[6].data == {"error": "soft"} and got[4].data == {"exception": "boom"} and got[1].data == {"response": "250 OK id=1aB-2"}


def test_drift(spark):
    t = "id int, config map<string,string>, from string"
    held = spark.createDataFrame([(1, {"a": "1"}, "f"), (2, {"a": "1"}, "f"), (3, {"a": "1"}, None), (4, {}, "f")], t)
    new = spark.createDataFrame([(1, {"a": "1", "b": "2"}, "f"), (2, {"b": "2"}, "f"), (3, {"a": "1"}, "f"), (5, {}, "f")], t)
    got = {r.id: r.drift for r in op.config_drift(held, new).collect()}
    assert got == {1: "same", 2: "changed", 3: "changed", 4: "gone", 5: "new"}


def test_nested_drift_keeps_every_id(spark):
    t = "id int, config string, from string"
    held = spark.createDataFrame([(1, '{"a":[1,2]}', "f"), (2, '{"a":1}', "f"), (3, None, "f"), (4, "{}", "f"), (6, None, "f"), (7, "{}", None)], t)
    new = spark.createDataFrame([(1, '{"a":[2,1]}', "f"), (2, '{"a":2}', "f"), (3, "{}", "f"), (5, "{}", "f"), (6, None, "f"), (7, "{}", "f")], t)
    got = {r.id: r.drift for r in op.nested_drift(held, new).collect()}
    assert got == {1: "same", 2: "changed", 3: "changed", 4: "gone", 5: "new", 6: "same", 7: "changed"}


def test_nested_json_is_compared_leniently():
    assert fn.json_holds({"a": [1, {"b": 2}]}, {"a": [{"b": 2, "c": 3}, 1], "x": 0})
    assert not fn.json_holds({"a": [1, 1]}, {"a": [1, 2]})
    assert not fn.json_holds({"a": 1}, {"a": True})
    assert not fn.json_holds({"a": 1}, {})


def test_fingerprint(spark):
    row = spark.sql("select timestamp_ntz'2016-11-24 15:06:40' d, timestamp_ntz'1969-12-31 23:59:50' e, encode('abc', 'utf-8') b")
    got = row.select(fn.fingerprint(F.col("d"), F.col("b")).alias("f"), fn.fingerprint(F.col("e"), F.col("b")).alias("g")).first()
    assert got.f == "oh5jb4:a9993e364706816aba3e25717850c26c9cd0d89d"
    assert got.g.startswith("-a:")


def test_mime_nesting(spark):
    part = "array<struct<filename:string,cid:string,mimeType:string,isRelated:boolean>>"
    rel, loose = ("i", None, "image/png", True), ("f", None, "application/pdf", False)
    df = spark.createDataFrame([
        (1, "t", "h", [rel, loose]), (2, "t", None, [rel]), (3, None, "h", [rel]), (4, "t", None, [rel, loose]), (5, None, None, [])],
        f"msg_id int, contentText string, contentHtml string, attachments {part}")
    got = {r.msg_id: r.plan for r in op.mime_plan(df).collect()}
    assert got == {1: "mixed[alternative[text, related[html, inline]], file]", 2: "text", 3: "related[html, inline]", 4: "mixed[text, file, file]"}
    assert [r.msg_id for r in op.require_body(df).collect()] == [5]
    assert op.mime_parts(df).where("msg_id = 1").count() == 4


def test_unknown_kinds_are_reported(spark):
    tasks = spark.createDataFrame([(1, '{"dataset":{"kind":"inline","rows":[]}}'), (2, '{"dataset":{"kind":"odd"}}'), (3, "{}")], "id int, data string")
    got = {r.taskId: r.error for r in registry.unknown_kinds(tasks, "dataset", registry.DATASETS).collect()}
    assert got == {2: "Unknown dataset: odd", 3: "Unknown dataset: none"}


def test_update_by_id(spark):
    rows = spark.createDataFrame([(1, "new", 5), (2, "new", 6)], "id int, state string, n int")
    got = update_by_id(rows, spark.createDataFrame([(2, "done", None)], "id int, state string, n int"), "id", ["state", "n"])
    assert sorted(map(tuple, got.collect())) == [(1, "new", 5), (2, "done", 6)]


def test_keyed_tables_swap_whole_versions(spark, tmp_path, monkeypatch):
    folder, schema = str(tmp_path / "t"), "id bigint, state string, n int"
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, state string")
    held = lambda: sorted(map(tuple, keyed.read(spark, folder, schema).collect()))
    assert held() == []
    keyed.update(rows((1, "x")), folder, "id", schema, ["state"])
    keyed.insert(rows(*[(k, "new") for k in range(50)]), folder, "id", schema, buckets=8)
    before = keyed._index(spark, folder)[1]
    keyed.update(rows((3, "done"), (99, "lost")), folder, "id", schema, ["state"])
    keyed.insert(rows((50, "new")), folder, "id", schema)
    want = [(k, "done" if k == 3 else "new", None) for k in range(51)]
    assert held() == want
    after = keyed._index(spark, folder)[1]
    assert 0 < sum(before[k] != after[k] for k in after) <= 3  # the buckets of 3, 99 and 50
    real = store.commit

    def dies(*args, **kwargs):
        raise RuntimeError

    monkeypatch.setattr(store, "commit", dies)
    with pytest.raises(keyed.Conflict):
        keyed.update(rows((3, "half")), folder, "id", schema, ["state"])
    monkeypatch.setattr(store, "commit", real)
    assert held() == want

    def raced(*args, **kwargs):  # another writer commits this version first
        monkeypatch.setattr(store, "commit", real)
        keyed.update(rows((4, "first")), folder, "id", schema, ["state"])
        real(*args, **kwargs)

    monkeypatch.setattr(store, "commit", raced)
    with pytest.raises(keyed.Conflict):
        keyed.update(rows((4, "second")), folder, "id", schema, ["state"])
    assert dict(r[:2] for r in held())[4] == "first"


def test_messages_are_stored_once_and_their_files_archived(spark, tmp_path):
    folder, archive, target, checkpoint = (str(tmp_path / x) for x in ("in", "archive", "out", "cp"))

    def deliver(*texts):
        rows = [(t, ["a@x", "b@x"], ["c@x"], datetime(2024, 1, 1, 0, 0, len(t)), t.encode()) for t in texts]
        spark.createDataFrame(rows, inbox.MESSAGE).coalesce(1).write.mode("append").parquet(folder)

    deliver("one", "two", "two")
    inbox.ingest(spark, folder, archive, target, checkpoint)
    deliver("three", "one")
    inbox.ingest(spark, folder, archive, target, checkpoint)
    inbox.ingest(spark, folder, archive, target, checkpoint)
    rows = lambda: sorted((r.subject, r["from"], r["to"], bytes(r.body)) for r in store.read_batches(spark, target, inbox.INBOX).collect())
    want = sorted((t, "a@x", "c@x", t.encode()) for t in ("one", "two", "three"))
    assert rows() == want
    assert glob.glob(f"{archive}/**/*.parquet", recursive=True)  # at least the first delivery has been consumed
    inbox.ingest(spark, folder, archive, target, str(tmp_path / "lost"))  # the checkpoint is gone, what is left is read again
    assert rows() == want
