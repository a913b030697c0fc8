"""Checks of a query plan before it runs: the physical plan's nodes and the optimiser's size estimates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

BROADCAST_BYTES, MOST_COLUMNS, DEEPEST = 100 << 20, 500, 200


class Severity(Enum):
    INFO = "INFO"
    WARNING = "WARNING"
    ERROR = "ERROR"


@dataclass(frozen=True)
class LintWarning:
    rule: str
    severity: Severity
    message: str
    suggestion: str = ""


@dataclass
class LintReport:
    warnings: list[LintWarning] = field(default_factory=list)

    @property
    def has_errors(self) -> bool:
        return any(w.severity is Severity.ERROR for w in self.warnings)

    @property
    def has_warnings(self) -> bool:
        return any(w.severity is not Severity.INFO for w in self.warnings)

    def summary(self) -> str:
        return "\n".join(f"[{w.severity.value}] {w.rule}: {w.message}" + (f" {w.suggestion}" if w.suggestion else "") for w in self.warnings) or "No findings."


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def estimates(df: DataFrame) -> tuple[int | None, int | None]:
    """(bytes, rows) that the optimiser expects; None where it doesn't know."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    size, rows = int(str(stats.sizeInBytes())), stats.rowCount()
    return (None if size >= 2**62 else size), (int(str(rows.get())) if rows.isDefined() else None)


def _join_sides(df: DataFrame) -> list[int]:
    """Estimated bytes of both sides of every join."""
    found, stack = [], [df._jdf.queryExecution().optimizedPlan()]
    while stack:
        node = stack.pop()
        children = [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            found += [int(str(c.stats().sizeInBytes())) for c in children]
        stack += children
    return found


def lint(df: DataFrame) -> LintReport:
    """Findings on a batch plan; nothing is executed."""
    if df.isStreaming:
        raise TypeError("a streaming frame has no plan to check before it starts")
    plan, out = physical_plan(df), []
    if "CartesianProduct" in plan or re.search(r"BroadcastNestedLoopJoin \w+, (Cross|Inner)\s*$", plan, re.M):
        out.append(LintWarning("CARTESIAN_PRODUCT", Severity.ERROR, "every row meets every row.", "Add a join condition."))
    if "BroadcastNestedLoopJoin" in plan:
        out.append(LintWarning("BROADCAST_NESTED_LOOP", Severity.WARNING, "a join without an equality compares all pairs.", "Add an equality to its condition."))
    if any("PushedFilters: []" in x and "PartitionFilters: []" in x for x in plan.splitlines() if "FileScan" in x):
        out.append(LintWarning("FULL_TABLE_SCAN", Severity.INFO, "a scan has no filter.", "Filter on its columns, best on partitions."))
    if "SortMergeJoin" in plan and (sides := _join_sides(df)) and min(sides) < BROADCAST_BYTES:
        out.append(LintWarning("BROADCAST_CANDIDATE", Severity.INFO, f"one side of a sort-merge join is about {min(sides)} bytes.", "Consider broadcast()."))
    if len(df.columns) > MOST_COLUMNS:
        out.append(LintWarning("EXCESSIVE_COLUMNS", Severity.WARNING, f"{len(df.columns)} columns.", "Select what is needed."))
    if any(len(x) - len(x.lstrip(" :+-|")) > DEEPEST for x in plan.splitlines()):
        out.append(LintWarning("DEEP_PLAN", Severity.WARNING, "the plan is very deep.", "Write or checkpoint an intermediate result."))
    return LintReport(out)


def check_collect_safety(df: DataFrame, *, max_rows: int = 100_000, max_bytes: int | None = None) -> LintWarning | None:
    """A warning if collecting would likely bring more than the limits to the driver."""
    size, rows = estimates(df)
    if rows is not None and rows > max_rows:
        return LintWarning("COLLECT_SAFETY", Severity.WARNING, f"about {rows} rows; the limit is {max_rows}.", "Aggregate or write instead.")
    if max_bytes is not None and size is not None and size > max_bytes:
        return LintWarning("COLLECT_SAFETY", Severity.WARNING, f"about {size} bytes; the limit is {max_bytes}.", "Aggregate or write instead.")
    return None
