"""Processing only what is new: a ledger of work items.

Two parts.  ``fold_log`` and ``messages_to_load`` read the log of earlier runs:
every (run, topic, partition) is a work item whose state follows from its last log
entry, and the messages outside all ranges that are done are still to be loaded.
``WorkLedger`` keeps the items of our own runs in a shared folder: pending, leased
and done, with leases that expire and are renewed during writes, fencing tokens that reject
writers whose lease has passed to another, and one output path for each token, of
which the state ``done`` records the one to read.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fold_log(log: DataFrame, *, now_ms: int | None = None, lease_ms: int | None = None) -> DataFrame:
    """State of each work item: ``run_id, topic, partition_id, start_offset, stop_offset, state, fence``.

    The entry with the greatest logged_ms decides (ties: the greatest state in
    alphabetical order, then the widest range).  committed is ``done``; started is
    ``leased`` while ``now_ms - logged_ms <= lease_ms`` (never without these two),
    and every other end is ``pending`` again.  ``fence`` is the logged_ms that won:
    an entry written with a lower one changes nothing.  Letter case and blanks of
    state do not matter.  Rows with a null key or logged_ms are no entries.
    """
    state = F.lower(F.trim("state"))
    last = F.max_by(
        F.struct("start_offset", "stop_offset", state.alias("state"), "logged_ms"),
        F.struct("logged_ms", state.alias("state"), "stop_offset", "start_offset"),
    )
    alive = F.lit(False)
    if now_ms is not None and lease_ms is not None:
        alive = (F.col("e.state") == "started") & (F.lit(now_ms) - F.col("e.logged_ms") <= lease_ms)
    return (
        log.where(F.col("run_id").isNotNull() & F.col("topic").isNotNull() & F.col("partition_id").isNotNull() & F.col("logged_ms").isNotNull())
        .groupBy("run_id", "topic", "partition_id")
        .agg(last.alias("e"))
        .select(
            "run_id", "topic", "partition_id", "e.start_offset", "e.stop_offset",
            F.when(F.col("e.state") == "committed", "done").when(alive, "leased").otherwise("pending").alias("state"),
            F.col("e.logged_ms").alias("fence"),
        )
    )


def mark_loaded(messages: DataFrame, done: DataFrame, *, span: int = 4096) -> DataFrame:
    """Distinct messages with ``loaded``: does the offset lie in a range of ``done``?

    A sweep over offsets instead of a join on ranges: ranges and messages of one
    (topic, partition) are cut into spans of ``span`` offsets, and a running count of
    open ranges decides.  Ranges are clipped to the offsets that there are, so a wild
    bound costs nothing.  Work is linear in messages plus ranges, and a partition
    that holds most messages is spread over its spans.
    """
    keys = ["topic", "partition_id"]
    span_of = lambda c: F.floor(c / span).cast("long")
    there = messages.groupBy(*keys).agg(F.min("msg_offset").alias("least"), F.max("msg_offset").alias("most"))
    ranges = (
        done.join(there, keys)
        .withColumns({"start_offset": F.greatest("start_offset", "least"), "stop_offset": F.least("stop_offset", F.col("most") + 1)})
        .where(F.col("stop_offset") > F.col("start_offset"))
        .select(*keys, "start_offset", "stop_offset", F.explode(F.sequence(span_of(F.col("start_offset")), span_of(F.col("stop_offset") - 1))).alias("span"))
    )
    edge = lambda at, step: ranges.select(
        *keys, "span", at.cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(step).alias("step"),
        F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("long").alias("payload_crc"),
    )
    opens = edge(F.greatest(F.col("start_offset"), F.col("span") * span), 1)
    closes = edge(F.col("stop_offset"), -1).where(F.col("at") < (F.col("span") + 1) * span)
    rows = (
        messages.where(F.col("topic").isNotNull() & F.col("partition_id").isNotNull() & F.col("msg_offset").isNotNull())
        .groupBy(*keys, "msg_offset")
        .agg(F.min(F.struct("batch_id", "payload_crc")).alias("m"))
        .select(
            *keys, span_of(F.col("msg_offset")).alias("span"), F.col("msg_offset").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
            "m.batch_id", "m.payload_crc",
        )
    )
    sweep = Window.partitionBy(*keys, "span").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        opens.unionByName(closes).unionByName(rows)
        .withColumn("open", F.sum("step").over(sweep))
        .where(F.col("kind") == 1)
        .select(*keys, F.col("at").alias("msg_offset"), "batch_id", "payload_crc", (F.col("open") > 0).alias("loaded"))
    )


def messages_to_load(messages: DataFrame, log: DataFrame, *, now_ms: int | None = None, lease_ms: int | None = None, span: int = 4096) -> DataFrame:
    """``topic, partition_id, msg_offset`` of the messages that the next run still has to load.

    Left out are messages in a done range, those whose content (batch_id and
    payload_crc) lies in a done range anywhere, and those whose content has a smaller
    offset in the same partition.  A null batch_id or payload_crc is no known content:
    such a message repeats nothing.  Rows read twice count once.  With a clock
    (``now_ms``, ``lease_ms``) messages in the range of a live lease are left to its holder.
    """
    items = fold_log(log, now_ms=now_ms, lease_ms=lease_ms)
    done = items.where(F.col("state") != "pending" if now_ms is not None else F.col("state") == "done")
    marked = mark_loaded(messages, done, span=span)
    known = F.col("batch_id").isNotNull() & F.col("payload_crc").isNotNull()
    content = ["batch_id", "payload_crc"]
    named = marked.where(known)
    # groups are the copies of one batch; per partition first, so that a batch with many copies is reduced early
    first = named.groupBy(*content, "topic", "partition_id").agg(F.min("msg_offset").alias("msg_offset"), F.max("loaded").alias("loaded"))
    anywhere = Window.partitionBy(*content)
    fresh = first.withColumn("loaded", F.max("loaded").over(anywhere)).where(~F.col("loaded"))
    unknown = marked.where(~known & ~F.col("loaded"))
    columns = ["topic", "partition_id", "msg_offset"]
    return fresh.select(*columns).unionByName(unknown.select(*columns))


class StaleWriter(RuntimeError):
    """The fencing token is not the newest of the item: its lease went to another."""


class WorkLedger:
    """Work items in a shared folder, one small file per state change.

    ``<folder>/<item>/<token>.json`` holds state number ``token`` of an item.  A file
    is created only if it does not exist yet (Hadoop's ``create`` without overwrite),
    so of two writers that want the same token one fails: tokens are fencing tokens.
    A crash leaves the last complete state; an expired lease can be taken again.
    The folder must be on a file system that creates a file once only (HDFS, local or
    network disks; an object store needs a committer with conditional writes).
    """

    def __init__(self, spark: SparkSession, folder: str, *, lease_ms: int = 600_000, clock: Callable[[], int] | None = None):
        self.folder, self.lease_ms = folder.rstrip("/"), lease_ms
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _states(self, item: str) -> list[int]:
        at = self._path(f"{self.folder}/{item}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, item: str, token: int) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{item}/{token}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else {}

    def _last(self, item: str) -> tuple[dict, int]:
        """The last complete state and the newest token; a file still empty (being written, or of a crash) is no state."""
        tokens = self._states(item)
        entry = next((e for t in reversed(tokens) if (e := self._read(item, t))), {"state": "pending", "until": 0})
        return entry, tokens[-1] if tokens else -1

    def _write(self, item: str, token: int, entry: dict) -> bool:
        path = self._path(f"{self.folder}/{item}/{token}.json")
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(path):
                return False  # another writer was first
            raise
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        return True

    def add(self, items: list[str]) -> None:
        """Register items as pending; known ones keep their state."""
        for item in items:
            if not self._states(item):
                self._write(item, 0, {"state": "pending", "until": 0})

    def items(self) -> list[str]:
        at = self._path(self.folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def state(self, item: str) -> tuple[str, int]:
        """(pending, leased or done; newest token).  An expired lease reads as pending."""
        entry, token = self._last(item)
        if entry["state"] == "leased" and entry["until"] < self.clock():
            return "pending", token
        return entry["state"], token

    def lease(self, item: str, worker: str) -> int | None:
        """Take a pending item; the fencing token, or None if it isn't pending or another was first."""
        state, token = self.state(item)
        if state != "pending":
            return None
        entry = {"state": "leased", "worker": worker, "until": self.clock() + self.lease_ms}
        return token + 1 if self._write(item, token + 1, entry) else None

    def renew(self, item: str, token: int) -> int:
        """Extend a lease; the new fencing token, which replaces ``token``.  StaleWriter if it isn't the newest lease."""
        entry = self._leased(item, token) | {"until": self.clock() + self.lease_ms}
        if not self._write(item, token + 1, entry):
            raise StaleWriter(f"{item}: token {token} was overtaken")
        return token + 1

    def _leased(self, item: str, token: int) -> dict:
        tokens = self._states(item)
        entry = self._read(item, token) if tokens and tokens[-1] == token else {}
        if entry.get("state") != "leased":
            raise StaleWriter(f"{item}: token {token}, newest {tokens[-1] if tokens else None}")
        return entry

    def finish(self, item: str, token: int, path: str | None = None) -> None:
        """Mark as done with its output ``path``; raises StaleWriter unless ``token`` is the item's newest lease."""
        self._leased(item, token)
        if not self._write(item, token + 1, {"state": "done", "until": 0, "path": path}):
            raise StaleWriter(f"{item}: token {token} was overtaken")

    def release(self, item: str, token: int) -> None:
        """Give a lease back after a failure."""
        if self._states(item)[-1:] != [token] or not self._write(item, token + 1, {"state": "pending", "until": 0}):
            raise StaleWriter(f"{item}: token {token}")

    def output_path(self, base: str, item: str, token: int) -> str:
        """Where the attempt that took ``token`` writes: a path of its own, so that no attempt touches another's files."""
        return f"{base.rstrip('/')}/item={item}/token={token}"

    def process(self, worker: str, base: str, build: Callable[[str], DataFrame]) -> list[str]:
        """Lease every pending item, write its output and mark it as done; the items done here.

        The lease is renewed every third of its time while the output is written.
        """
        ended = []
        for item in self.items():
            if (token := self.lease(item, worker)) is None:
                continue
            path = self.output_path(base, item, token)
            keeper = _Keeper(self, item, token)
            try:
                with keeper:
                    build(item).write.mode("overwrite").parquet(path)
            except Exception:
                self.release(item, keeper.token)
                raise
            self.finish(item, keeper.token, path)
            ended.append(item)
        return ended

    def process_together(self, worker: str, base: str, build: Callable[[list[str]], DataFrame]) -> list[str]:
        """Lease all pending items, write the output of all of them in one job and mark them as done; the items done here.

        ``build(items)`` gives rows with a column ``item``.  The attempt has a folder
        of its own, named after its items and tokens; each item's state records its part of it.
        """
        held = {item: token for item in self.items() if (token := self.lease(item, worker)) is not None}
        if not held:
            return []
        attempt = f"{base.rstrip('/')}/attempt={hashlib.sha256(json.dumps(sorted(held.items())).encode()).hexdigest()[:16]}"
        keepers = [_Keeper(self, item, token) for item, token in held.items()]
        try:
            with _Keepers(keepers, self.lease_ms):
                build(list(held)).write.mode("overwrite").partitionBy("item").parquet(attempt)
        except Exception:
            for k in keepers:
                self.release(k.item, k.token)
            raise
        ended = []
        for k in keepers:
            path = f"{attempt}/item={k.item}"
            try:
                self.finish(k.item, k.token, path if self._fs.exists(self._path(path)) else "")
            except StaleWriter:  # its lease went to another while we wrote: theirs is read
                continue
            ended.append(k.item)
        return ended

    def finished_output(self, spark: SparkSession, base: str) -> DataFrame | None:
        """Output of the done items only, from the paths they record; what other attempts left behind is not read."""
        paths = []
        for item in self.items():
            entry, _ = self._last(item)
            if entry["state"] == "done":
                # items done before paths were recorded lie in the item's own folder; an empty path is an item without rows
                path = entry.get("path")
                paths += [f"{base.rstrip('/')}/item={item}" if path is None else path] if path != "" else []
        return spark.read.parquet(*paths) if paths else None


class _Keeper:
    """Renews a lease from a thread of its own until the block ends; ``token`` is the newest one taken."""

    def __init__(self, ledger: WorkLedger, item: str, token: int):
        self.ledger, self.item, self.token = ledger, item, token
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def renew(self) -> bool:
        """Is there a lease left to be renewed?"""
        try:
            self.token = self.ledger.renew(self.item, self.token)
        except StaleWriter:  # finish() with this token fails as well
            return False
        except Exception:  # the folder could not be reached: the next turn tries again
            pass
        return True

    def _run(self) -> None:
        while not self._end.wait(self.ledger.lease_ms / 3000) and self.renew():
            pass

    def __enter__(self) -> _Keeper:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()


class _Keepers:
    """Renews many leases from one thread until the block ends."""

    def __init__(self, keepers: list[_Keeper], lease_ms: int):
        self.keepers, self.wait_s = keepers, lease_ms / 3000
        self._end = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        live = self.keepers
        while live and not self._end.wait(self.wait_s):
            live = [k for k in live if k.renew()]

    def __enter__(self) -> _Keepers:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join()


def partition_item(topic: str, partition: int) -> str:
    """Name of the work item of a queue partition, fit for a folder."""
    return f"{quote(topic, safe='')}-{partition}".replace("%", "_x")


def load_next(ledger: WorkLedger, base: str, messages: DataFrame, log: DataFrame, *, worker: str = "next run", now_ms: int | None = None, lease_ms: int | None = None) -> DataFrame:
    """The messages that the next run loads, by the ledger: ``topic, partition_id, msg_offset``.

    Every partition of the queue is a work item.  The run leases the pending ones,
    writes what ``messages_to_load`` leaves of them, in one job, under paths of its
    tokens, and marks them as done.  Read back are the paths of the done states alone,
    so an attempt that failed or lost its leases leaves nothing behind, and a run that
    is repeated after a crash goes on with the items that are not done.
    """
    spark = messages.sparkSession
    known = messages.where("topic is not null and partition_id is not null").select("topic", "partition_id").distinct().collect()  # partitions of the queue
    names = [(r.topic, r.partition_id, partition_item(r.topic, r.partition_id)) for r in known]
    ledger.add(sorted(n for *_, n in names))

    def build(items: list[str]) -> DataFrame:
        mine = spark.createDataFrame([n for n in names if n[2] in set(items)], "topic STRING, partition_id INT, item STRING")
        todo = messages_to_load(messages, log, now_ms=now_ms, lease_ms=lease_ms)
        return todo.join(F.broadcast(mine.withColumn("partition_id", F.col("partition_id").cast(todo.schema["partition_id"].dataType))), ["topic", "partition_id"])

    ledger.process_together(worker, base, build)
    out = ledger.finished_output(spark, base)
    columns = ["topic", "partition_id", "msg_offset"]
    return out.select(*columns) if out is not None else messages.select(*columns).limit(0)
