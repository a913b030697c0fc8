"""Retries with growing pauses."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JNetworkError

_log = logging.getLogger(__name__)
TRANSIENT: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError, OSError, Py4JNetworkError)


@dataclass(frozen=True)
class RetryConfig:
    """Attempts, first pause, longest pause and growth; without exceptions named, the transient ones count."""

    max_attempts: int = 3
    base_delay: float = 1.0
    max_delay: float = 60.0
    backoff_factor: float = 2.0
    retryable_exceptions: tuple[type[BaseException], ...] = ()

    def __post_init__(self) -> None:
        if self.max_attempts < 1:
            raise ValueError("at least one attempt is needed")

    def delay(self, attempt: int) -> float:
        """Pause after the attempt of this number, from 1."""
        return min(self.base_delay * self.backoff_factor ** (attempt - 1), self.max_delay)


def retry(config: RetryConfig | None = None) -> Callable:
    """Decorator: call again after an exception of the config's kinds; others are raised at once."""
    cfg = config or RetryConfig()
    kinds = cfg.retryable_exceptions or TRANSIENT

    def decorate(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def call(*args: Any, **named: Any) -> Any:  # noqa: ANN401
            for attempt in range(1, cfg.max_attempts + 1):
                try:
                    return fn(*args, **named)
                except kinds as e:
                    if attempt == cfg.max_attempts:
                        raise
                    _log.warning("attempt %d of %s failed: %s", attempt, fn.__name__, e)
                    time.sleep(cfg.delay(attempt))
            raise AssertionError

        return call

    return decorate
