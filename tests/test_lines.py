import pytest

from tidemark.functions import lines

GOOD = "put proc.load.1m 1288946927 0.36 host=foo  cluster=c0"


def parsed(spark, texts, **how):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "command INT, line STRING")
    return {r.line: r for r in lines.parse_lines(df.drop("command"), **how).collect()}


@pytest.mark.parametrize(
    "line,kind,value",
    [
        (GOOD, "FLOAT", 0.36),
        ("put a 1 5 cluster=c", "INT", 5),
        ("put a 1 -9223372036854775808 cluster=c", "INT", -(2**63)),
        ("put a 1 1e3 cluster=c", "FLOAT", 1000.0),
        ("put a 1 [1.62,2.1] cluster=c", "FLOAT_LIST", [1.62, 2.1]),
        ("put a 1 [1,2,3,4,5] cluster=c", "INT_LIST", [1, 2, 3, 4, 5]),
        ("put a 1 [1,2,3.0] cluster=c host=x\r", "FLOAT_LIST", [1.0, 2.0, 3.0]),
        ("put a 1 [] cluster=c", "INT_LIST", []),
    ],
)
def test_values(spark, line, kind, value):
    r = parsed(spark, [line])[line]
    assert r.error is None and r.value_type == kind
    got = r[kind.lower()] if kind.endswith("LIST") else r[f"{kind.lower()}_value"]
    assert got == pytest.approx(value, rel=1e-6)


BAD = {
    "put a 1 5": "not enough arguments",
    "put a 0 5 cluster=c": "bad timestamp",
    "put a x 5 cluster=c": "bad timestamp",
    "put a 2147483648 5 cluster=c": "timestamp out of range",
    "put a 1 [0[ cluster=c": "closing bracket",
    "put a 1 [1,] cluster=c": "bad list value",
    "put a 1 [1,x] cluster=c": "bad list value",
    "put a 1 9223372036854775808 cluster=c": "bad value",
    "put a 1 NaN cluster=c": "bad value",
    "put a 1 1e99 cluster=c": "bad value",
    "put a 1 5 cluster=": "bad tag",
    "put a 1 5 =c": "bad tag",
    "put a 1 5 cluster=b=c": "bad tag",
    "put a 1 5 cluster=c cluster=c": "duplicate tag",
    "put a! 1 5 cluster=c": "illegal character",
    "put a 1 5 host=ü cluster=c": "illegal character",
    "put a 1 5 host=c": "shard tag",
    "get a": "unknown command",
    "  ": "empty",
    "put a 1 5 cluster=c " + "x" * 2048: "line too long",
}


def test_rejects(spark):
    got = parsed(spark, BAD)
    assert {k: r.error for k, r in got.items()} == BAD
    assert all(r.metric is None and r.tags is None for r in got.values())


def test_commands_dead_letters_and_empty(spark):
    df = spark.createDataFrame([(t, 1) for t in ("commit 12", "version", GOOD, "put a", None)], "line STRING, ts INT")
    x = lines.parse_lines(df.drop("ts"))
    assert {r.argument for r in x.where("command = 'commit'").collect()} == {12}
    assert lines.valid_points(x).count() == 1
    assert {r.error for r in lines.dead_letters(x).collect()} == {"not enough arguments"} | {r.error for r in x.where("line is null").collect()} - {None}
    assert lines.parse_lines(df.drop("ts").limit(0)).collect() == []


def test_json(spark):
    bodies = [
        '{"metric": "web1/load", "timestamp": 10, "value": 1.5, "tags": {"cluster": "c"}}',
        '[{"metric": "a", "timestamp": 11, "value": 7}, {"metric": "a", "timestamp": 12, "value": [1, 2.5]}, {"metric": "a", "timestamp": 13, "value": [1, 2]}]',
        "nonsense", "", None, '{"metric": null}',
    ]
    bodies += ['[{"metric": "b", "timestamp": 14, "value": "x"}, {"timestamp": 15, "value": 1}, {"metric": "b", "timestamp": "soon", "value": 1}, {"metric": "b", "timestamp": 4294967296, "value": 1}, {"metric": "b", "timestamp": 16, "value": [1, "x"]}]', "[]"]
    x = lines.parse_json_points(spark.createDataFrame([(b,) for b in bodies], "body STRING"))
    got = {r.ts: r for r in x.where("error is null").collect()}
    assert set(got) == {10, 11, 12, 13}
    assert got[10].metric == "l.load" and got[10].tags == {"cluster": "c", "host": "web1"} and got[10].float_value == 1.5
    assert got[11].int_value == 7 and got[12].float_list == [1.0, 2.5] and got[13].int_list == [1, 2]
    bad = sorted((r.error, r.rejected or "") for r in x.where("error is not null").collect())
    assert [e for e, _ in bad] == ["bad JSON", "bad list value", "bad timestamp", "bad value", "empty", "empty", "no metric", "no metric", "no object", "timestamp out of range"]
    assert bad[0][1] == "nonsense" and '"x"' in bad[3][1] and all(r.value_type is None and r.metric is None for r in x.where("error is not null").collect())
    assert lines.parse_json_points(spark.createDataFrame([], "body STRING")).collect() == []


def test_validation(spark):
    ddl = "metric STRING, tags MAP<STRING,STRING>, ts INT, int_value BIGINT, float_value FLOAT, int_list ARRAY<BIGINT>, float_list ARRAY<FLOAT>"
    t = {"cluster": "c"}
    rows = [
        ("m", t, 1, 1, None, None, None), ("m", t, 1, None, None, None, None), ("m", t, 1, None, float("nan"), None, None), ("m", t, -1, 1, None, None, None),
        ("m", {}, 1, 1, None, None, None), ("m", None, 1, 1, None, None, None), ("m m", t, 1, 1, None, None, None), ("m", {"a b": "c", "cluster": "x"}, 1, 1, None, None, None),
        ("m", {"host": "c"}, 1, 1, None, None, None), (None, t, None, 1, None, None, None),
    ]
    got = [r.error for r in lines.validate(spark.createDataFrame(rows, ddl), shard_tags=("cluster",)).collect()]
    assert got == [None, "no value", "not finite", "timestamp out of range", "no tags", "no tags", "illegal character", "illegal character", "shard tag", "timestamp out of range"]


def test_tokens(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a  b ",), ("",), (None,)], "s STRING")
    r = df.select(lines.tokens(F.col("s")).alias("t"), lines.tokens(F.col("s"), keep_empty=True).alias("k")).collect()
    assert [x.t for x in r] == [["a", "b"], [], None] and r[0].k == ["", "a", "", "b", ""]
