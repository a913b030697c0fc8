"""Expectations, gates and profiles.

All expectations of a gate are answered by one aggregate over one scan: each contributes aggregate columns and reads its
result from the row that comes back. Quarantine splits by the union of the failing conditions; rows for which a
condition is unknown (NULL) count as clean.
"""

from __future__ import annotations

import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_log = logging.getLogger(__name__)


@dataclass
class ExpectationResult:
    """Outcome of one expectation."""

    expectation: str
    passed: bool
    total_rows: int
    failing_rows: int = 0


@dataclass
class QualityReport:
    """Outcomes of a gate."""

    results: list[ExpectationResult] = field(default_factory=list)

    @property
    def passed(self) -> bool:
        return all(r.passed for r in self.results)

    def summary(self) -> str:
        lines = [f"[{'PASS' if r.passed else 'FAIL'}] {r.expectation} ({r.failing_rows}/{r.total_rows} failing)" for r in self.results]
        return "\n".join([*lines, f"Overall: {'PASS' if self.passed else 'FAIL'}"])

    def to_df(self, like: DataFrame) -> DataFrame:
        """One row an expectation."""
        rows = [(r.expectation, r.passed, int(r.total_rows), int(r.failing_rows)) for r in self.results]
        return like.sparkSession.createDataFrame(rows, "expectation string, passed boolean, total_rows long, failing_rows long")


class QualityError(Exception):
    """A gate that did not pass."""

    def __init__(self, report: QualityReport) -> None:
        self.report = report
        super().__init__("quality gate failed\n" + report.summary())


class Expectation(ABC):
    """A demand on a frame. The built-in ones fuse: they name aggregates and judge the values. Others may just define
    :meth:`validate`."""

    def failing_condition(self) -> Column | None:
        """True for rows that fail, where the demand is on rows."""
        return None

    @abstractmethod
    def validate(self, df: DataFrame) -> ExpectationResult:
        """Check ``df`` alone."""


class FusedExpectation(Expectation):
    """An expectation answered from aggregates."""

    name = "expectation"

    def aggregates(self) -> dict[str, Column]:
        """Aggregate columns to compute."""
        bad = self.failing_condition()
        return {} if bad is None else {"bad": F.count_if(bad)}

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        """(passed, failing rows) from the row count and the aggregates."""
        return values["bad"] == 0, values["bad"]

    def validate(self, df: DataFrame) -> ExpectationResult:
        return evaluate(df, [self]).results[0]


class NotNull(FusedExpectation):
    """None of the columns is NULL."""

    def __init__(self, *columns: str) -> None:
        if not columns:
            raise TypeError("NotNull needs at least one column")
        self.columns, self.name = columns, f"NotNull({', '.join(columns)})"

    def failing_condition(self) -> Column:
        return reduce(Column.__or__, (F.col(c).isNull() for c in self.columns))


class InRange(FusedExpectation):
    """Values within inclusive bounds; NULL passes."""

    def __init__(self, column: str, *, min_val: Any = None, max_val: Any = None) -> None:  # noqa: ANN401
        self.column, self.min_val, self.max_val = column, min_val, max_val
        self.name = f"InRange({column}, {min_val}, {max_val})"

    def failing_condition(self) -> Column | None:
        c = F.col(self.column)
        parts = ([c < self.min_val] if self.min_val is not None else []) + ([c > self.max_val] if self.max_val is not None else [])
        return reduce(Column.__or__, parts) if parts else None

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        bad = values.get("bad", 0)
        return bad == 0, bad


class MatchesRegex(FusedExpectation):
    """Values in which the pattern is found; NULL passes."""

    def __init__(self, column: str, pattern: str) -> None:
        self.column, self.pattern, self.name = column, pattern, f"MatchesRegex({column}, {pattern})"

    def failing_condition(self) -> Column:
        return ~F.col(self.column).rlike(self.pattern)


class Unique(FusedExpectation):
    """No two rows agree in the columns; NULL is a value."""

    def __init__(self, *columns: str) -> None:
        if not columns:
            raise TypeError("Unique needs at least one column")
        self.columns, self.name = columns, f"Unique({', '.join(columns)})"

    def aggregates(self) -> dict[str, Column]:
        return {"distinct": F.count_distinct(F.struct(*self.columns))}

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        return values["distinct"] == total, total - values["distinct"]


class RowCount(FusedExpectation):
    """A number of rows within inclusive bounds."""

    def __init__(self, *, min_count: int | None = None, max_count: int | None = None) -> None:
        self.min_count, self.max_count, self.name = min_count, max_count, f"RowCount({min_count}, {max_count})"

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        low, high = self.min_count, self.max_count
        return (low is None or total >= low) and (high is None or total <= high), 0


class ColumnExists(FusedExpectation):
    """Columns that must be there, and of a type if none is missing."""

    def __init__(self, *columns: str, dtype: str | None = None) -> None:
        self.columns, self.dtype, self.name = columns, dtype, f"ColumnExists({', '.join(columns)})"

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        have = {f.name: f.dataType.simpleString() for f in df.schema}
        wrong = [c for c in self.columns if c not in have]
        if not wrong and self.dtype is not None:
            wrong = [c for c in self.columns if have[c] != self.dtype]
        return not wrong, len(wrong)


class FreshnessExpectation(FusedExpectation):
    """The newest timestamp is at most ``max_age`` old; stale rows are counted even then."""

    def __init__(self, column: str, max_age: timedelta, *, as_of: datetime | None = None) -> None:
        self.column, self.max_age, self.as_of, self.name = column, max_age, as_of, f"Freshness({column}, {max_age})"

    def _cutoff(self) -> Column:
        return F.lit(self.as_of or datetime.now(UTC)) - F.lit(self.max_age)

    def failing_condition(self) -> Column:
        return F.col(self.column) < self._cutoff()

    def aggregates(self) -> dict[str, Column]:
        return {"bad": F.count_if(self.failing_condition()), "fresh": F.max(F.col(self.column)) >= self._cutoff()}

    def judge(self, total: int, values: dict[str, Any], df: DataFrame) -> tuple[bool, int]:
        return bool(values["fresh"]), values["bad"] if values["fresh"] is not None else 0


def fused_row(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One row with the row count and the aggregates of all fusing expectations."""
    columns = [F.count(F.lit(1)).alias("total")]
    for k, e in enumerate(expectations):
        if isinstance(e, FusedExpectation):
            columns += [c.alias(f"{k}_{name}") for name, c in e.aggregates().items()]
    return df.agg(*columns)


def _result(k: int, e: Expectation, row: Row, df: DataFrame) -> ExpectationResult:
    if not isinstance(e, FusedExpectation):
        return e.validate(df)
    values = {name: row[f"{k}_{name}"] for name in e.aggregates()}
    passed, bad = e.judge(row["total"], values, df)
    return ExpectationResult(e.name, passed, row["total"], bad)


def evaluate(df: DataFrame, expectations: Sequence[Expectation]) -> QualityReport:
    """Answer all expectations; the built-in ones share a single job."""
    row = fused_row(df, expectations).first()
    return QualityReport([_result(k, e, row, df) for k, e in enumerate(expectations)])


def split_quarantine(df: DataFrame, expectations: Sequence[Expectation], *, drop_unknown: bool = False) -> tuple[DataFrame, DataFrame] | None:
    """(bad, clean) by the failing conditions of all expectations, or None where none is on rows. With
    ``drop_unknown``, rows whose verdict is NULL are in neither."""
    conditions = [c for e in expectations if (c := e.failing_condition()) is not None]
    if not conditions:
        return None
    bad = reduce(Column.__or__, conditions)
    return df.where(bad), df.where(~bad if drop_unknown else ~F.coalesce(bad, F.lit(False)))


class QualityGate:
    """Expectations and what to do if one fails: raise, warn or quarantine."""

    def __init__(self, *expectations: Expectation, on_fail: str = "raise", quarantine_handler: Callable[[DataFrame], Any] | None = None) -> None:
        if on_fail not in ("raise", "warn", "quarantine"):
            raise ValueError(f"on_fail is raise, warn or quarantine, not {on_fail!r}")
        if on_fail == "quarantine" and quarantine_handler is None:
            raise ValueError("quarantine needs a quarantine_handler")
        self.expectations, self.on_fail, self.quarantine_handler = expectations, on_fail, quarantine_handler

    def check(self, df: DataFrame) -> QualityReport:
        return evaluate(df, self.expectations)

    def enforce(self, df: DataFrame, report: QualityReport | None = None) -> DataFrame:
        """``df``, or what is clean of it; a report that is at hand isn't computed again."""
        report = report or self.check(df)
        if report.passed:
            return df
        if self.on_fail == "raise":
            raise QualityError(report)
        if self.on_fail == "warn":
            _log.warning("quality gate failed\n%s", report.summary())
            return df
        parts = split_quarantine(df, self.expectations)
        if parts is None:
            _log.warning("no expectation tells bad rows apart; nothing is quarantined")
            return df
        self.quarantine_handler(parts[0])
        return parts[1]


# --- profiles -------------------------------------------------------------------------------------------------------


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    null_count: int
    null_pct: float
    distinct_count: int
    min_val: str | None
    max_val: str | None
    mean: float | None


@dataclass
class DataProfile:
    row_count: int
    columns: list[ColumnProfile]

    def summary(self) -> str:
        head = f"{'column':<24}{'type':<16}{'nulls':>10}{'null %':>9}{'distinct':>12}  {'min':<20}{'max':<20}{'mean':>14}"
        rows = [
            f"{c.name:<24}{c.dtype:<16}{c.null_count:>10}{c.null_pct:>9.2f}{c.distinct_count:>12}  {str(c.min_val):<20}{str(c.max_val):<20}"
            + (f"{c.mean:>14.4f}" if c.mean is not None else f"{'-':>14}")
            for c in self.columns
        ]
        return "\n".join([f"rows: {self.row_count}", head, *rows])


#: Standard error asked of estimated distinct counts; Spark's default of 0.05 leaves a tenth at two standard errors, so
#: one column in thirty goes beyond it. 0.02 makes sketches of 4,096 registers (1.6 %), some 3 KB a column.
DISTINCT_RSD = 0.02


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def profile_row(df: DataFrame, *, exact: bool = False, text_order: bool = False) -> DataFrame:
    """All figures in one row; ``text_order`` compares values as strings."""
    out = [F.count(F.lit(1)).alias("total")]
    for k, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        ordered = c.cast("string") if text_order or not _orderable(f.dataType) or isinstance(f.dataType, (T.ArrayType, T.StructType)) else c
        counted = c if _orderable(f.dataType) else F.to_json(c)
        out += [
            F.count_if(c.isNull()).alias(f"{k}_nulls"), (F.count_distinct(counted) if exact else F.approx_count_distinct(counted, DISTINCT_RSD)).alias(f"{k}_distinct"),
            F.min(ordered).cast("string").alias(f"{k}_min"), F.max(ordered).cast("string").alias(f"{k}_max"),
            (F.avg(c.cast("double")) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")).alias(f"{k}_mean"),
        ]
    return df.agg(*out)


def profile_df(df: DataFrame, *, exact: bool = False, text_order: bool = False) -> DataFrame:
    """One row a column: name, dtype, row_count, null_count, distinct_count, min_val, max_val, mean."""
    one = profile_row(df, exact=exact, text_order=text_order)
    parts = [
        F.struct(
            F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col("total").alias("row_count"),
            *(F.col(f"{k}_{a}").alias(b) for a, b in (("nulls", "null_count"), ("distinct", "distinct_count"), ("min", "min_val"), ("max", "max_val"), ("mean", "mean"))),
        )
        for k, f in enumerate(df.schema)
    ]
    return one.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def profile(df: DataFrame, *, text_order: bool = False) -> DataProfile:
    """Profile all columns in one job."""
    row = profile_row(df, text_order=text_order).first()
    total = row["total"]
    columns = []
    for k, f in enumerate(df.schema):
        nulls = row[f"{k}_nulls"]
        columns.append(
            ColumnProfile(f.name, f.dataType.simpleString(), nulls, 100.0 * nulls / total if total else 0.0, row[f"{k}_distinct"], row[f"{k}_min"], row[f"{k}_max"], row[f"{k}_mean"])
        )
    return DataProfile(total, columns)
