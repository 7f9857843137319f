"""Progress of streaming queries: batches, rows, failures and latencies."""

from __future__ import annotations

import threading
from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps the last ``most`` batch durations and counters of all queries of a session."""

    def __init__(self, most: int = 1000):
        self._lock = threading.Lock()
        self.durations: deque[int] = deque(maxlen=most)
        self.batches = self.rows = self.failed = self.started = 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        with self._lock:
            self.started += 1

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            self.batches += 1
            self.rows += max(p.numInputRows, 0)
            self.durations.append(int(p.batchDuration))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            self.failed += event.exception is not None

    def report(self) -> dict[str, float]:
        """Counters, and median and 95th percentile of batch durations in milliseconds."""
        with self._lock:
            d = sorted(self.durations)
            at = lambda q: float(d[min(len(d) - 1, int(q * len(d)))]) if d else 0.0
            return {
                "started": self.started, "failed": self.failed, "batches": self.batches, "rows": self.rows, "p50_ms": at(0.5), "p95_ms": at(0.95),
                "failed_percent": 100.0 * self.failed / self.started if self.started else 0.0,
            }

    def text(self) -> str:
        return "".join(f"{k} {v:g}\n" for k, v in self.report().items())

    def csv(self, *, header: bool = True) -> str:
        """The report as a line of comma-separated values, for a file that is appended to."""
        report = self.report()
        return ",".join(report) * header + "\n" * header + ",".join(f"{v:g}" for v in report.values()) + "\n"
