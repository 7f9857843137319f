import json

import pytest

from tidemark import cli, config
from tidemark.streaming.monitor import Progress

T = 1_709_251_200  # a multiple of a day


def test_whole_way(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    lines = [f"put cpu.load {T + 60 * k} {k % 7} host=h{h} cluster=c{h % 2}" for k in range(120) for h in range(4)]
    (src / "a.txt").write_text("\n".join(lines) + "\nnonsense\n")
    points, dead, roll, check = (str(tmp_path / n) for n in ("points", "dead", "roll", "check"))
    progress = Progress()
    spark.streams.addListener(progress)
    cli.main(["ingest", str(src), points, "--dead", dead, "--checkpoint", check, "--generations", "01/03/24:1"], spark)
    assert spark.read.parquet(points).count() == 480 and spark.read.parquet(dead).count() == 1
    body = {"start": T * 1000, "end": (T + 7200) * 1000, "queries": [{"metric": "cpu.load", "aggregator": "sum", "tags": {"host": "h0|h1"}, "downsample": "1h-max"}]}
    got = [json.loads(x) for x in cli.main(["query", points, json.dumps(body)], spark)]
    assert {g["tags"]["host"] for g in got} == {"h0", "h1"} and all(set(g["dps"].values()) == {6.0} for g in got)
    cli.main(["rollup", points, roll, "--start", str(T), "--stop", str(T + 86400), "--granularity", "hour"], spark)
    assert spark.read.parquet(roll).where("resolution = 'hour' and agg = 'max'").count() == 8
    cli.main(["rollup", roll, roll + "d", "--start", str(T), "--stop", str(T + 86400), "--granularity", "day"], spark)
    assert {r.value for r in spark.read.parquet(roll + "d").where("agg = 'max'").collect()} == {6.0}
    assert cli.main(["suggest", points, "tagv", "h", "--max", "3"], spark) == ["h0", "h1", "h2"]
    health = json.loads(cli.main(["health", points, "cpu.load", "host", "30m", "--now", str(T + 5400)], spark)[0])
    assert health == {"n_before": 4, "n_after": 4, "healthy": True}
    report = progress.report()
    assert report["failed"] == 0 and "p95_ms" in progress.text()


def test_arguments():
    for bad in (["rollup", "a", "b", "--start", "1", "--stop", "2", "--granularity", "week"], ["query"], []):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_settings_are_merged_and_checked(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"source": {"kind": "lines", "path": "x"}, "sinks": [], "checkpoint": "c", "dead": "d"}))
    got = config.load(str(tmp_path / "a.json"), "source.path=y", "source.files_per_batch=2", {"dead": None}, "every=30s")
    assert got == {"source": {"kind": "lines", "path": "y", "files_per_batch": 2}, "sinks": [], "checkpoint": "c", "every": "30s"}
    assert config.Pipeline.of(got).every == "30s"
    for bad in ({"source": {}, "sinks": []}, got | {"colour": 1}):
        with pytest.raises(ValueError):
            config.Pipeline.of(bad)


def test_pipeline_with_several_sinks_and_replies(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    (src / "a.txt").write_text(f"put a {T} 1 cluster=c\ncommit 7\nput a {T + 1} 2 cluster=c\ncommit 9\nbroken\n")
    at = lambda n: str(tmp_path / n)
    settings = {
        "source": {"kind": "lines", "path": str(src)}, "checkpoint": at("ck"), "generations": "01/03/24:1", "dead": at("dead"), "replies": at("replies"),
        "sinks": [{"kind": "points", "path": at("points")}, {"kind": "failover", "main": {"kind": "fail"}, "drop": {"kind": "parquet", "path": at("copy")}}, {"kind": "blackhole"}],
    }
    (tmp_path / "p.json").write_text(json.dumps(settings))
    cli.main(["pipeline", str(tmp_path / "p.json")], spark)
    assert [spark.read.parquet(at(n)).count() for n in ("points", "copy", "dead")] == [2, 2, 1]
    assert [r.line for r in spark.read.parquet(at("replies")).orderBy("seq").collect()] == ["OK 7 = 0", "OK 9 = 0"]
    for bad in ({"sinks": [{"kind": "drain"}]}, {"source": {"kind": "queue"}}):
        with pytest.raises(ValueError):
            config.start_ingest(spark, settings | bad)


def test_report_as_csv():
    head, line = Progress().csv().splitlines()
    assert head.startswith("started,failed") and len(head.split(",")) == len(line.split(",")) and Progress().csv(header=False).count("\n") == 1
