"""Regular upkeep of one table."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidewright.job.metrics import MetricsSink, emit_event
from tidewright.sources.versioned import analyze_table, optimize_table, vacuum_table


@dataclass(frozen=True)
class MaintenanceResult:
    table_name: str
    optimized: bool
    vacuumed: bool
    analyzed: bool
    duration_ms: float


class MaintenanceRunner:
    """Optimize, vacuum and analyze, in this order; each can be switched off."""

    def __init__(
        self, table_name: str, *, optimize: bool = True, vacuum: bool = True, analyze: bool = True, zorder_by: Sequence[str] | None = None,
        retention_hours: float = 168, analyze_columns: Sequence[str] | None = None, spark: SparkSession | None = None, metrics_sink: MetricsSink | None = None,
    ) -> None:
        self.name, self.spark, self.sink = table_name, spark, metrics_sink
        self.optimize, self.vacuum, self.analyze = optimize, vacuum, analyze
        self.zorder_by, self.retention_hours, self.columns = zorder_by, retention_hours, analyze_columns

    def run(self) -> MaintenanceResult:
        began = time.time()
        if self.optimize:
            optimize_table(self.name, zorder_by=self.zorder_by, spark=self.spark)
        if self.vacuum:
            vacuum_table(self.name, retention_hours=self.retention_hours, spark=self.spark)
        if self.analyze:
            analyze_table(self.name, columns=self.columns, spark=self.spark)
        out = MaintenanceResult(self.name, self.optimize, self.vacuum, self.analyze, (time.time() - began) * 1000)
        emit_event(self.sink, "maintenance", "maintenance_complete", out.duration_ms, None, self.name, {"optimized": out.optimized, "vacuumed": out.vacuumed, "analyzed": out.analyzed})
        return out
