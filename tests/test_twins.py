"""Queries against their SQL twins on the smallest tables; TALLYROOM_ALL=1 runs every one."""

import os
from collections import Counter

import duckdb
import pytest

from tallyroom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "reading_owner", "last_reading", "void_last_reading", "inline_rows", "pending_recipients", "batch_chunks", "delivery_state",
    "config_drift", "mime_plan", "mime_parts", "inbox_ingest", "event_not_seen", "out_of_order", "ban_periods", "ban_state",
    "poll_changes", "cell_json", "split_questions", "known_type", "dataset_plugin",
]
NAMES = [n for n in catalog.ORACLES if os.environ.get("TALLYROOM_ALL") or n in SOME]


def rows_of(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in place], Counter(tuple(repr(r[i]) for i in place) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    found = db.execute(catalog.ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in found.description], found.fetchall())


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
