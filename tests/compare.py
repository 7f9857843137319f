"""Side-by-side run of queries and their SQL: python -m tests.compare [--sf DIR] [NAME...]."""

from __future__ import annotations

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "points queue_messages kafka_inputs offset_samples metric_catalog review_items pack_sizes"
).split()


def plain(v):
    """A value in a form that both engines agree on."""
    import datetime

    import numpy as np

    if v is None:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(v))
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def duck(folder: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def compare(spark, c, folder: str, query, sql: str) -> tuple[bool, str]:
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = [tuple(plain(r[n]) for n in names) for r in df.collect()]
    rel = c.execute(sql)
    theirs_names = [d[0] for d in rel.description]
    if sorted(theirs_names) != names:
        return False, f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    key = repr
    a, b = sorted(mine, key=key), sorted(theirs, key=key)
    if a == b:
        return True, f"{len(a)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return False, f"{len(a)} and {len(b)} rows; {bad}"


if __name__ == "__main__":
    import __spark_entry__ as e
    from tidemark.session import local_session

    args = sys.argv[1:]
    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark, c = local_session(), duck(folder)
    queries, sqls = e.queries(), e.oracle_sql()
    failed = 0
    for name in args or queries:
        began = time.time()
        try:
            ok, what = compare(spark, c, folder, queries[name], sqls[name]) if name in sqls else (True, f"no SQL, {queries[name](spark, folder).count()} rows")
        except Exception as x:  # noqa: BLE001
            ok, what = False, str(x)[:1500]
        failed += not ok
        print("ok  " if ok else "FAIL", name, what, f"{time.time() - began:.1f}s", flush=True)
    sys.exit(failed)
