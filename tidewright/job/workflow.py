"""The frame of a job: configuration, retries, metrics and quality checks around ``run``."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewright.job.config import JobConfig
from tidewright.job.logs import configure_logging
from tidewright.job.metrics import MetricsSink, emit_event
from tidewright.job.retry import RetryConfig, retry
from tidewright.job.secrets import inject_dbutils
from tidewright.job.session import active_fallback
from tidewright.operators.quality import QualityGate


class Workflow(ABC):
    """Subclasses define :meth:`run`; :meth:`execute` runs it with everything around it."""

    def __init__(
        self, *, spark: SparkSession | None = None, dbutils: Any = None, log_level: int | str | None = None, config: JobConfig | None = None,  # noqa: ANN401
        metrics: MetricsSink | None = None, retry_config: RetryConfig | None = None,
    ) -> None:
        configure_logging(log_level)
        self.spark = active_fallback(spark)
        if dbutils is not None:
            inject_dbutils(dbutils)
        self.config, self.metrics, self.retry_config = config, metrics, retry_config
        self._time: datetime | None = None

    @property
    def execution_time(self) -> datetime | None:
        """Logical time of the run; None before the first."""
        return self._time

    @abstractmethod
    def run(self) -> None:
        """The work."""

    def run_at_time(self, time: datetime | None = None) -> None:
        """Run for a logical time, by default now."""
        self._time = time or datetime.now(UTC)
        self.run()

    def emit_metric(self, event_type: str, **fields: Any) -> None:  # noqa: ANN401
        names = {"duration_ms": None, "row_count": None, "table_name": None, "metadata": None, "batch_id": None} | fields
        emit_event(self.metrics, type(self).__name__, event_type, names["duration_ms"], names["row_count"], names["table_name"], names["metadata"], names["batch_id"])

    def quality_check(self, df: DataFrame, gate: QualityGate, *, table_name: str | None = None) -> DataFrame:
        """Check once, emit the outcome, and enforce with the same report."""
        report = gate.check(df)
        bad = [r.expectation for r in report.results if not r.passed]
        rows = report.results[0].total_rows if report.results else None
        self.emit_metric("quality_check", row_count=rows, table_name=table_name, metadata={"passed": report.passed, "failed": bad})
        return gate.enforce(df, report)

    def execute(self, time_of_run: datetime | None = None) -> None:
        for key, value in (self.config.spark_configs if self.config else {}).items():
            self.spark.conf.set(key, value)
        began = time.time()
        passed = lambda: (time.time() - began) * 1000
        self.emit_metric("job_start")
        work: Callable[[], None] = lambda: self.run_at_time(time_of_run)
        try:
            (retry(self.retry_config)(work) if self.retry_config else work)()
            self.emit_metric("job_complete", duration_ms=passed())
        except BaseException as e:
            self.emit_metric("job_failed", duration_ms=passed(), metadata={"error": str(e)[:2000], "error_type": type(e).__name__})
            raise
        finally:
            if self.metrics is not None:
                self.metrics.flush()
