"""Compare registered queries with their SQL checks: ``python check.py [pattern] [sf]``."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

from shelfwise.plans import catalog
from shelfwise.sources.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    pattern = re.compile(sys.argv[1] if len(sys.argv) > 1 else ".")
    folder = f"/root/testdata/sf{sys.argv[2] if len(sys.argv) > 2 else '0.01'}"
    spark = local_session()
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name, entry in catalog.QUERIES.items():
        if not pattern.search(name):
            continue
        start = time.time()
        try:
            df = entry.run(spark, folder)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        sql = entry.check()
        if sql is None:
            print(f"rows  {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        try:
            cursor = db.execute(sql)
            want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
        except Exception as error:
            print(f"SQL   {name}: {str(error)[:700]}", flush=True)
            bad += 1
            continue
        if got == want:
            note = "" if got else "  EMPTY"
            print(f"ok    {name}: {len(got)} rows, {took:.1f}s{note}", flush=True)
            continue
        bad += 1
        extra = [r for r in got if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        print(f"DIFF  {name}: spark {len(got)} sql {len(want)} {sorted(df.columns)}")
        for row in extra:
            print("   spark", row)
        for row in lost:
            print("   sql  ", row, flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
