"""Small tables for tests."""

from __future__ import annotations

POINTS = (
    "point_id BIGINT, metric STRING, tags MAP<STRING,STRING>, ts INT, value_type STRING, int_value BIGINT, float_value FLOAT, "
    "int_list ARRAY<BIGINT>, float_list ARRAY<FLOAT>, write_ms BIGINT, batch_id BIGINT"
)
CATALOG = "metric STRING, unit STRING, value_type STRING, step_s INT, lowest DOUBLE, highest DOUBLE"


def frame(spark, rows, extra=""):
    """rows: dicts; missing columns are null, point_id counts up."""
    names = [c.split()[0] for c in POINTS.split(", ")]
    more = [c.split()[0] for c in extra.split(", ") if c]
    data = [tuple((r | {"point_id": r.get("point_id", k + 1)}).get(n) for n in names + more) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, POINTS + (", " + extra if extra else ""))


def catalog(spark, rows):
    names = [c.split()[0] for c in CATALOG.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CATALOG)


def gauge(values, *, metric="m.x", tags=None, start=600_000, step=60, kind="float_value", **more):
    return [
        {"metric": metric, "tags": tags or {"host": "a", "cluster": "c"}, "ts": start + k * step, "value_type": "FLOAT", kind: v, "write_ms": (start + k * step) * 1000} | more
        for k, v in enumerate(values)
    ]
