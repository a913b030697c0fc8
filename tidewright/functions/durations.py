"""Durations as texts."""

from __future__ import annotations

import re
from datetime import timedelta

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def parse_duration_ms(value: object) -> int:
    """Milliseconds of an int, or of a text such as ``250 ms``, ``1 s``, ``2 m``; 0 for anything else."""
    if isinstance(value, bool):
        return 0
    if isinstance(value, int):
        return value
    if isinstance(value, timedelta):
        return round(value.total_seconds() * 1000)
    found = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h)\s*", value) if isinstance(value, str) else None
    return int(found[1]) * _UNITS[found[2]] if found else 0
