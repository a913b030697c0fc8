"""What happens in a micro-batch, as JSON lines."""

from __future__ import annotations

import json
import logging
import time
import uuid
from dataclasses import dataclass, field
from typing import Any


@dataclass
class BatchContext:
    """A batch and the id that ties its log lines together."""

    batch_id: int
    source: str = ""
    correlation_id: str = field(default_factory=lambda: uuid.uuid4().hex[:12])
    began: float = field(default_factory=time.time)

    def elapsed_ms(self) -> float:
        return (time.time() - self.began) * 1000


class BatchLogger:
    """Lines batch_start, batch_complete, batch_error, batch_skip and batch_dlq."""

    def __init__(self, name: str = "tidewright.batches") -> None:
        self.log = logging.getLogger(name)

    def _line(self, event: str, context: BatchContext, level: int = logging.INFO, **more: Any) -> None:  # noqa: ANN401
        base = {"event": event, "batch_id": context.batch_id, "source": context.source, "correlation_id": context.correlation_id}
        self.log.log(level, json.dumps(base | more, default=str))

    def start(self, context: BatchContext) -> None:
        self._line("batch_start", context)

    def complete(self, context: BatchContext, row_count: int) -> None:
        self._line("batch_complete", context, row_count=row_count, duration_ms=context.elapsed_ms())

    def error(self, context: BatchContext, error: BaseException | str) -> None:
        self._line("batch_error", context, logging.ERROR, error=str(error)[:2000], duration_ms=context.elapsed_ms())

    def skip(self, context: BatchContext, reason: str) -> None:
        self._line("batch_skip", context, reason=reason[:500])

    def dlq(self, context: BatchContext, row_count: int, table: str) -> None:
        self._line("batch_dlq", context, logging.WARNING, row_count=row_count, table=table)
