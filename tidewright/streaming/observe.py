"""Progress history and health of running streams."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum
from threading import Lock
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewright.functions.durations import parse_duration_ms
from tidewright.job.metrics import MetricsSink, emit_event
from tidewright.job.session import active_fallback


@dataclass(frozen=True)
class QueryProgressSnapshot:
    query_id: str
    name: str | None
    batch_id: int
    batch_duration_ms: int
    num_input_rows: int
    input_rows_per_second: float
    processed_rows_per_second: float
    sources: list[Any] = field(default_factory=list)
    sink: Any = None

    @classmethod
    def of(cls, p: dict[str, Any]) -> QueryProgressSnapshot:
        rate = lambda k: float(p.get(k) or 0.0)
        return cls(
            str(p.get("id", "")), p.get("name"), int(p.get("batchId", -1)), parse_duration_ms(p.get("batchDuration")), int(p.get("numInputRows") or 0),
            rate("inputRowsPerSecond"), rate("processedRowsPerSecond"), list(p.get("sources") or []), p.get("sink"),
        )


class QueryProgressObserver(StreamingQueryListener):
    """Keeps the last progress reports of streams, by default all of a session's."""

    def __init__(
        self, *, query_name: str | None = None, max_history: int = 100, on_progress: Callable[[QueryProgressSnapshot], None] | None = None,
        metrics_sink: MetricsSink | None = None,
    ) -> None:
        self.name, self.callback, self.sink = query_name, on_progress, metrics_sink
        self._history: deque[QueryProgressSnapshot] = deque(maxlen=max_history)
        self._lock, self._spark = Lock(), None

    def attach(self, spark: SparkSession | None = None) -> QueryProgressObserver:
        self._spark = active_fallback(spark)
        self._spark.streams.addListener(self)
        return self

    def detach(self) -> None:
        if self._spark is not None:
            self._spark.streams.removeListener(self)
            self._spark = None

    def take(self, progress: dict[str, Any]) -> None:
        """One progress report."""
        snapshot = QueryProgressSnapshot.of(progress)
        if self.name is not None and snapshot.name != self.name:
            return
        with self._lock:
            self._history.append(snapshot)
        if self.callback:
            self.callback(snapshot)
        metadata = {"processed_rows_per_second": snapshot.processed_rows_per_second}
        emit_event(self.sink, snapshot.name or snapshot.query_id, "query_progress", float(snapshot.batch_duration_ms), snapshot.num_input_rows, None, metadata, snapshot.batch_id)

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802, ANN401
        pass

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802, ANN401
        import json

        self.take(json.loads(event.progress.json))

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802, ANN401
        pass

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802, ANN401
        pass

    def history(self, limit: int | None = None) -> list[QueryProgressSnapshot]:
        """Oldest first; of ``limit`` the newest."""
        with self._lock:
            found = list(self._history)
        return found if limit is None else found[-limit:] if limit else []

    def latest(self) -> QueryProgressSnapshot | None:
        with self._lock:
            return self._history[-1] if self._history else None


class HealthStatus(Enum):
    HEALTHY = 0
    DEGRADED = 1
    UNHEALTHY = 2


@dataclass(frozen=True)
class HealthDetail:
    """One check: its name, outcome and what it saw."""

    check: str
    status: HealthStatus
    message: str


@dataclass
class HealthResult:
    """The worst of all checks."""

    details: list[HealthDetail] = field(default_factory=list)

    @property
    def status(self) -> HealthStatus:
        return max((d.status for d in self.details), key=lambda s: s.value, default=HealthStatus.HEALTHY)

    @property
    def reasons(self) -> list[str]:
        """Why the status isn't healthy."""
        return [d.message for d in self.details if d.status is not HealthStatus.HEALTHY]


class StreamingHealthCheck:
    """Unhealthy: not running, or no new batch for ``stale_after`` seconds; degraded: slow batches or a low rate."""

    def __init__(
        self, query: StreamingQuery, *, max_batch_duration_ms: int | None = None, min_processing_rate: float | None = None, stale_after: float = 300,
        clock: Callable[[], float] = time.time,
    ) -> None:
        self.query, self.slow, self.rate, self.stale_after, self.clock = query, max_batch_duration_ms, min_processing_rate, stale_after, clock
        self._batch: int | None = None
        self._since = clock()

    def evaluate(self) -> HealthResult:
        """Every check that applies, passed ones too; a query that isn't running gets no other."""
        out = HealthResult()

        def add(check: str, bad: bool, status: HealthStatus, message: str) -> None:
            out.details.append(HealthDetail(check, status if bad else HealthStatus.HEALTHY, message))

        if not self.query.isActive:
            add("active", True, HealthStatus.UNHEALTHY, "the query is not running")
            return out
        add("active", False, HealthStatus.UNHEALTHY, "the query is running")
        progress, now = self.query.lastProgress, self.clock()
        waited = now - self._since
        if progress is None:
            add("progress", waited > self.stale_after, HealthStatus.UNHEALTHY, f"no progress for {waited:.0f} s")
            return out
        snapshot = QueryProgressSnapshot.of(progress)
        if snapshot.batch_id != self._batch:
            self._batch, self._since, waited = snapshot.batch_id, now, 0.0
        add("progress", waited > self.stale_after, HealthStatus.UNHEALTHY, f"batch {snapshot.batch_id} is the last for {waited:.0f} s")
        if self.slow is not None:
            add("batch_duration", snapshot.batch_duration_ms > self.slow, HealthStatus.DEGRADED, f"a batch took {snapshot.batch_duration_ms} ms")
        if self.rate is not None:
            add("processing_rate", snapshot.processed_rows_per_second < self.rate, HealthStatus.DEGRADED, f"{snapshot.processed_rows_per_second:g} rows a second")
        return out
