"""Compare every query with its SQL twin: python tools/check_twins.py [folder] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])
from tallyroom.plans import catalog  # noqa: E402
from tallyroom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in place], Counter(tuple(repr(r[i]) for i in place) for r in rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session()
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, folder)
            columns, got = rows_of(df.columns, df.collect())
        except Exception as e:
            print(f"{name}: SPARK ERROR {str(e)[:1500]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in catalog.ORACLES:
            print(f"{name}: {sum(got.values())} rows, no twin, {took:.1f}s")
            continue
        try:
            start = time.time()
            result = db.execute(catalog.ORACLES[name])
            wanted_columns, wanted = rows_of([c[0] for c in result.description], result.fetchall())
        except Exception as e:
            print(f"{name}: SQL ERROR {str(e)[:1500]}")
            bad += 1
            continue
        same = columns == wanted_columns and got == wanted
        note = "ok" if same else "DIFFERS"
        print(f"{name}: {note} {sum(got.values())}/{sum(wanted.values())} rows, {took:.1f}s, twin {time.time() - start:.1f}s")
        if not same:
            bad += 1
            print("   columns", columns, wanted_columns)
            print("   spark only", list((got - wanted).items())[:3])
            print("   twin only ", list((wanted - got).items())[:3])
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
