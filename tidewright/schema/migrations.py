"""Versioned migrations with a history table."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.job.session import active_fallback
from tidewright.schema.validators import MigrationError
from tidewright.sources.versioned import VersionedTable

HISTORY = T.StructType(
    [
        T.StructField("version", T.StringType(), False),
        T.StructField("description", T.StringType()),
        T.StructField("applied_at", T.TimestampType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("duration_ms", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class MigrationStep:
    version: str
    description: str
    up: Callable[[SparkSession], None]
    pre_validate: Callable[[SparkSession], bool] | None = None
    post_validate: Callable[[SparkSession], bool] | None = None


@dataclass
class MigrationRunResult:
    applied: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    failed: str | None = None


class MigrationRunner:
    """Runs registered steps in the order of their versions (as strings), those that succeeded once never again."""

    def __init__(self, history_table: str, *, spark: SparkSession | None = None, location: str | None = None) -> None:
        self.spark = active_fallback(spark)
        self.history = VersionedTable(history_table, HISTORY, location, spark=self.spark)
        self.steps: dict[str, MigrationStep] = {}

    def register(self, *steps: MigrationStep) -> MigrationRunner:
        for step in steps:
            if step.version in self.steps:
                raise ValueError(f"migration {step.version} is registered twice")
            self.steps[step.version] = step
        return self

    def applied(self) -> list[str]:
        return sorted(r["version"] for r in self.history.dataframe().where("success").select("version").distinct().collect())

    def pending(self) -> list[MigrationStep]:
        done = set(self.applied())
        return [self.steps[v] for v in sorted(self.steps) if v not in done]

    def run(self, *, dry_run: bool = False) -> MigrationRunResult:
        done = set(self.applied())
        out = MigrationRunResult(skipped=[v for v in sorted(self.steps) if v in done])
        for step in (self.steps[v] for v in sorted(self.steps) if v not in done):
            if step.pre_validate and not step.pre_validate(self.spark):
                raise MigrationError(f"migration {step.version} may not start")
            if dry_run:
                out.applied.append(step.version)
                continue
            began, error = time.time(), None
            try:
                step.up(self.spark)
                if step.post_validate and not step.post_validate(self.spark):
                    error = "the check after it failed"
            except Exception as e:  # noqa: BLE001  recorded, then the run halts
                error = f"{type(e).__name__}: {e}"
            self._record(step, error, (time.time() - began) * 1000)
            if error:
                out.failed = step.version
                return out
            out.applied.append(step.version)
        return out

    def _record(self, step: MigrationStep, error: str | None, duration_ms: float) -> None:
        row = (step.version, step.description, datetime.now(UTC), error is None, error and error[:2000], duration_ms)
        self.history.write(self.spark.createDataFrame([row], HISTORY))

    def history_df(self):  # noqa: ANN201
        return self.history.dataframe().orderBy(F.col("applied_at"))
