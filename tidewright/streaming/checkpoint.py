"""Streaming checkpoints: where they are, what they hold, and whether they are whole.

Files are reached through Hadoop, so checkpoints may lie in any store.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tidewright.job.session import active_fallback
from tidewright.schema.diff import SchemaDiff
from tidewright.sources.log import Files


@dataclass(frozen=True)
class CheckpointInfo:
    path: str
    last_batch_id: int | None
    offsets: list[dict]
    size_bytes: int


def _numbers(files: Files, folder: str) -> list[int]:
    return sorted(int(n) for n in files.names(folder) if n.isdigit())


class CheckpointManager:
    """Checkpoint folders below one base."""

    def __init__(self, base_path: str, *, spark: SparkSession | None = None) -> None:
        self.base, self.spark = base_path.rstrip("/"), active_fallback(spark)

    def path_for(self, source: str, sink: str) -> str:
        clean = lambda x: re.sub(r"[^0-9A-Za-z]", "_", x)
        return f"{self.base}/{clean(source)}__{clean(sink)}"

    def _files(self) -> Files:
        return Files(self.spark, self.base)

    def exists(self, path: str) -> bool:
        return self._files().exists(path)

    def reset(self, path: str) -> None:
        """Delete a checkpoint; nothing happens if there is none."""
        files = self._files()
        if files.exists(path):
            files.delete(path)

    def info(self, path: str) -> CheckpointInfo:
        """Last batch and its offsets; offset files are a version line and one JSON value a line."""
        files = self._files()
        if not files.exists(path):
            raise FileNotFoundError(path)
        batches = _numbers(files, f"{path}/offsets")
        offsets = []
        if batches:
            for line in files.read(f"{path}/offsets/{batches[-1]}").splitlines():
                try:
                    value = json.loads(line)
                except ValueError:
                    continue
                if isinstance(value, dict):
                    offsets.append(value)
        size = files.fs.getContentSummary(files.path(path)).getLength()
        return CheckpointInfo(path, batches[-1] if batches else None, offsets, size)


class CheckpointState(Enum):
    HEALTHY = "healthy"
    DEGRADED = "degraded"
    CORRUPTED = "corrupted"
    MISSING = "missing"


@dataclass
class CheckpointDiagnostic:
    path: str
    state: CheckpointState
    last_batch_id: int | None = None
    pending_batches: list[int] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)


def diagnose_checkpoint(path: str, *, spark: SparkSession | None = None) -> CheckpointDiagnostic:
    """Missing; corrupted with commits that have no offsets or gaps between batches; degraded with other issues."""
    files = Files(active_fallback(spark), path)
    if not files.exists(path):
        return CheckpointDiagnostic(path, CheckpointState.MISSING, issues=["there is no such folder"])
    issues, broken = [], []
    if not files.exists(f"{path}/offsets"):
        issues.append("there are no offsets")
    if not files.exists(f"{path}/metadata"):
        issues.append("there is no metadata file")
    offsets, commits = _numbers(files, f"{path}/offsets"), _numbers(files, f"{path}/commits")
    if orphans := sorted(set(commits) - set(offsets)):
        broken.append(f"commits without offsets: {orphans}")
    for name, found in (("offsets", offsets), ("commits", commits)):
        if found and (gaps := sorted(set(range(found[0], found[-1] + 1)) - set(found))):
            broken.append(f"gaps in {name}: {gaps}")
    pending = sorted(set(offsets) - set(commits))
    if len(pending) > 1:
        issues.append(f"batches that were planned but not committed: {pending}")
    state = CheckpointState.CORRUPTED if broken else CheckpointState.DEGRADED if issues else CheckpointState.HEALTHY
    return CheckpointDiagnostic(path, state, commits[-1] if commits else None, pending, broken + issues)


SCHEMA_FILE = "tidewright_schema.json"


@dataclass
class CompatibilityResult:
    compatible: bool
    changes: list = field(default_factory=list)
    recommendation: str = ""


def remember_schema(path: str, schema: T.StructType, *, spark: SparkSession | None = None) -> None:
    """Keep the source's schema beside a checkpoint, for :func:`check_compatibility`."""
    files = Files(active_fallback(spark), path)
    files.fs.mkdirs(files.path(path))
    files.put(f"{path}/{SCHEMA_FILE}", schema.json())


def check_compatibility(path: str, schema: T.StructType, *, spark: SparkSession | None = None) -> CompatibilityResult:
    """Whether a stream of this schema can go on from the checkpoint; an unknown old schema counts as compatible."""
    files = Files(active_fallback(spark), path)
    old = None
    for name in (f"{path}/{SCHEMA_FILE}", f"{path}/sources/0"):
        if files.exists(name) and not files.fs.getFileStatus(files.path(name)).isDirectory():
            try:
                old = T.StructType.fromJson(json.loads(files.read(name)))
                break
            except (ValueError, KeyError, TypeError):
                continue
    if old is None:
        return CompatibilityResult(True, [], "No earlier schema is known.")
    diff = SchemaDiff(old, schema)
    if diff.has_breaking_changes():
        return CompatibilityResult(False, diff.changes(), "Columns went or changed type: start from a new checkpoint.")
    return CompatibilityResult(True, diff.changes(), "The checkpoint can be used." if not diff.changes() else "Only columns were added or became nullable: the checkpoint can be used.")
