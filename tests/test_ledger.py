import random
import time

import pytest

from pyspark.sql import functions as F

from tidemark.operators.ledger import StaleWriter, WorkLedger, fold_log, load_next, mark_loaded, messages_to_load

MESSAGES = "topic STRING, partition_id INT, msg_offset BIGINT, batch_id BIGINT, payload_crc BIGINT, n_points INT, append_ms BIGINT"
LOG = "run_id BIGINT, topic STRING, partition_id INT, start_offset BIGINT, stop_offset BIGINT, state STRING, logged_ms BIGINT"


def brute(messages, log):
    last = {}
    for run, topic, part, start, stop, state, ms in log:
        key = (run, topic, part)
        entry = (ms, state.strip().lower(), stop, start)
        last[key] = max(last.get(key, entry), entry)
    done = [(t, p, e[3], e[2]) for (_, t, p), e in last.items() if e[1] == "committed"]
    rows = {m[:5] for m in messages}
    loaded = {m for m in rows if any(m[0] == t and m[1] == p and a <= m[2] < b for t, p, a, b in done)}
    out = set()
    for m in rows - loaded:
        same = [o for o in rows if None not in m[3:] and o[3:] == m[3:]]
        if not any(o in loaded or (o[:2] == m[:2] and o[2] < m[2]) for o in same):
            out.add(m[:3])
    return out


@pytest.mark.parametrize("span", [4, 4096])
def test_messages_to_load_match_a_loop(spark, span):
    rnd = random.Random(5)
    messages = [(f"t{rnd.randrange(2)}", rnd.randrange(2), o, rnd.choice([None, *range(60)]), rnd.randrange(2), None, 0) for o in range(150)]
    messages += rnd.sample(messages, 20)
    log = []
    for run in range(40):
        start = rnd.randrange(140)
        for ms, state in enumerate(rnd.choice([["started"], ["started", "Committed "], ["started", "COMMITTED", "rolled_back"], ["started", "failed"], ["committed", "committed"]])):
            log.append((run, f"t{run % 2}", rnd.randrange(2) if run % 7 == 0 else run % 2, start, start + rnd.randrange(-2, 9), state, run * 10 + ms))
    log = [(r, t, p, min(s for rr, tt, pp, s, *_ in log if (rr, tt, pp) == (r, t, p)), max(e for rr, tt, pp, _, e, *_ in log if (rr, tt, pp) == (r, t, p)), s2, ms) for r, t, p, _, _, s2, ms in log]
    rnd.shuffle(log)
    got = messages_to_load(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(log, LOG), span=span)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(messages, log)


def test_states_of_items(spark):
    log = [(1, "t", 0, 0, 5, "started", 10), (1, "t", 0, 0, 5, "COMMITTED", 30), (1, "t", 0, 0, 5, "failed", 20), (2, "t", 0, 5, 9, "Started", 100), (3, "t", 0, 5, 9, "started", 10), (None, "t", 0, 0, 9, "committed", 1)]
    df = spark.createDataFrame(log, LOG)
    assert {(r.run_id, r.state, r.fence) for r in fold_log(df, now_ms=150, lease_ms=60).collect()} == {(1, "done", 30), (2, "leased", 100), (3, "pending", 10)}
    assert {r.state for r in fold_log(df).collect()} == {"done", "pending"}


def test_empty_tables(spark):
    m, log = spark.createDataFrame([], MESSAGES), spark.createDataFrame([], LOG)
    assert messages_to_load(m, log).collect() == []
    one = spark.createDataFrame([("t", 0, 7, None, None, None, None)], MESSAGES)
    assert [tuple(r) for r in messages_to_load(one, log).collect()] == [("t", 0, 7)]
    assert [r.loaded for r in mark_loaded(one, fold_log(log)).collect()] == [False]


def test_leases_and_fencing(spark, tmp_path):
    now = [1000]
    ledger = WorkLedger(spark, f"{tmp_path}/ledger", lease_ms=100, clock=lambda: now[0])
    ledger.add(["a", "b"])
    ledger.add(["a"])
    assert ledger.items() == ["a", "b"]
    first = ledger.lease("a", "w1")
    assert first == 1 and ledger.lease("a", "w2") is None and ledger.state("a")[0] == "leased"
    now[0] = 2000
    assert ledger.state("a")[0] == "pending"
    second = ledger.lease("a", "w2")
    assert second == 2
    with pytest.raises(StaleWriter):
        ledger.finish("a", first)
    with pytest.raises(StaleWriter):
        ledger.release("a", first)
    ledger.finish("a", second)
    assert ledger.state("a")[0] == "done" and ledger.lease("a", "w3") is None
    with pytest.raises(StaleWriter):
        ledger.finish("a", second)


def test_work_survives_failures_without_loss_or_repeat(spark, tmp_path):
    ledger, base = WorkLedger(spark, f"{tmp_path}/l"), f"{tmp_path}/out"
    ledger.add(["x", "y", "z"])
    broken = {"y"}

    def build(item):
        df = spark.createDataFrame([(item, k) for k in range(3)], "name STRING, k INT")
        return df.withColumn("k", df.k / 0) if item in broken else df

    with pytest.raises(Exception):
        ledger.process("w", base, build)
    assert {i: ledger.state(i)[0] for i in "xyz"} == {"x": "done", "y": "pending", "z": "pending"}
    broken.clear()
    assert ledger.process("w", base, build) == ["y", "z"]
    assert ledger.process("w", base, build) == []
    assert sorted((r.name, r.k) for r in ledger.finished_output(spark, base).collect()) == [(i, k) for i in "xyz" for k in range(3)]


def test_a_stale_writer_leaves_the_output_of_the_other_alone(spark, tmp_path):
    now, base = [1000], f"{tmp_path}/out"
    ledger = WorkLedger(spark, f"{tmp_path}/l", lease_ms=60_000, clock=lambda: now[0])
    other = WorkLedger(spark, f"{tmp_path}/l", lease_ms=60_000, clock=lambda: now[0])
    ledger.add(["x"])
    rows = lambda name: spark.createDataFrame([(name, k) for k in range(3)], "name STRING, k INT")

    def slow(item):  # outlives its lease; meanwhile another worker does the item, and then this one writes
        now[0] += 100_000
        assert other.process("b", base, lambda item: rows("b")) == ["x"]
        return rows("a")

    with pytest.raises(StaleWriter):
        ledger.process("a", base, slow)
    assert ledger.state("x")[0] == "done"
    assert sorted((r.name, r.k) for r in ledger.finished_output(spark, base).collect()) == [("b", k) for k in range(3)]
    assert ledger.process("a", base, lambda item: rows("c")) == []


def test_a_long_write_keeps_its_lease(spark, tmp_path):
    ledger, base, taken = WorkLedger(spark, f"{tmp_path}/l", lease_ms=1500), f"{tmp_path}/out", []
    ledger.add(["x"])

    def slow(item):
        time.sleep(4)
        taken.append(ledger.lease("x", "b"))
        return spark.range(3).toDF("k")

    assert ledger.process("a", base, slow) == ["x"] and taken == [None]
    ledger.add(["y"])
    assert ledger.lease("y", "a") == 1 and open(f"{tmp_path}/l/y/2.json", "w").close() is None
    assert ledger.state("y") == ("leased", 2)  # a renewal not yet written out frees nothing
    assert sorted(r.k for r in ledger.finished_output(spark, base).collect()) == [0, 1, 2]


def batch(spark, items, by):
    return spark.createDataFrame([(i, by, k) for i in items for k in range(2) if i != "empty"], "item STRING, worker STRING, k INT")


def test_items_are_written_together(spark, tmp_path):
    now, base = [1000], f"{tmp_path}/out"
    book = lambda: WorkLedger(spark, f"{tmp_path}/l", lease_ms=60_000, clock=lambda: now[0])
    ledger = book()
    ledger.add(["a", "b", "empty"])
    rows = lambda: sorted((r.worker, r.k) for r in ledger.finished_output(spark, base).collect())

    def crash(items):  # before anything is written
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.process_together("w1", base, crash)
    assert {ledger.state(i)[0] for i in ledger.items()} == {"pending"} and ledger.finished_output(spark, base) is None

    class Dies(WorkLedger):  # after the write, before and between the done states
        left = 1

        def finish(self, *a):
            if self.left == 0:
                raise KeyboardInterrupt
            self.left -= 1
            super().finish(*a)

    with pytest.raises(KeyboardInterrupt):
        Dies(spark, f"{tmp_path}/l", lease_ms=60_000, clock=lambda: now[0]).process_together("w2", base, lambda items: batch(spark, items, "w2"))
    assert sorted(ledger.state(i)[0] for i in ledger.items()) == ["done", "leased", "leased"]
    assert ledger.process_together("w3", base, lambda items: batch(spark, items, "w3")) == []  # the leases are still alive
    now[0] += 100_000

    def slow(items):  # outlives its leases; another does the items
        assert items == ["b", "empty"]
        now[0] += 100_000
        assert book().process_together("w5", base, lambda i: batch(spark, i, "w5")) == items
        return batch(spark, items, "w4")

    assert ledger.process_together("w4", base, slow) == []
    assert rows() == [("w2", 0), ("w2", 1), ("w5", 0), ("w5", 1)]
    assert ledger.process_together("w6", base, crash) == []


def test_next_run_by_the_ledger(spark, tmp_path, small):
    messages, log = spark.read.parquet(f"{small}/queue_messages.parquet"), spark.read.parquet(f"{small}/kafka_inputs.parquet")
    ledger, base = WorkLedger(spark, f"{tmp_path}/l"), f"{tmp_path}/out"
    want = sorted(map(tuple, messages_to_load(messages, log).collect()))
    assert sorted(map(tuple, load_next(ledger, base, messages, log).collect())) == want
    assert sorted(map(tuple, load_next(ledger, base, messages, log).collect())) == want  # nothing is loaded again
    assert {ledger.state(i)[0] for i in ledger.items()} == {"done"}
    odd = WorkLedger(spark, f"{tmp_path}/l2")
    assert load_next(odd, f"{base}2", messages.withColumn("topic", F.lit("a/b %")).limit(3), log).count() > 0
    assert load_next(WorkLedger(spark, f"{tmp_path}/l3"), f"{base}3", messages.limit(0), log).collect() == []


def test_a_live_lease_of_the_log_keeps_its_messages(spark):
    messages = spark.createDataFrame([("t", 0, k, k, k) for k in range(10)], "topic STRING, partition_id INT, msg_offset LONG, batch_id LONG, payload_crc LONG")
    log = spark.createDataFrame([(1, "t", 0, 2, 5, "started", 1000), (2, "t", 0, 5, 10**15, "committed", 900)], LOG)
    of = lambda **how: sorted(r.msg_offset for r in messages_to_load(messages, log, **how).collect())
    assert of() == [0, 1, 2, 3, 4] and of(now_ms=1500, lease_ms=600) == [0, 1] and of(now_ms=2000, lease_ms=600) == [0, 1, 2, 3, 4]


def test_a_folder_out_of_reach_is_an_error(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(Exception):
        WorkLedger(spark, f"{tmp_path}/file").add(["a"])
