"""Logging set-up."""

from __future__ import annotations

import logging
import os


def configure_logging(level: int | str | None = None) -> None:
    """Root level: the argument, ``LOG_LEVEL``, or INFO; the gateway's chatter is kept to errors."""
    chosen = level or os.environ.get("LOG_LEVEL", "INFO")
    logging.basicConfig(level=chosen.upper() if isinstance(chosen, str) else chosen, format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    logging.getLogger("py4j").setLevel(logging.ERROR)


def get_logger(name: str) -> logging.Logger:
    return logging.getLogger(name)
