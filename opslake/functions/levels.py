"""Ordered log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, lowest first.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def level_rank(level: Column) -> Column:
    """Position of a level, 0 for TRACE; null for anything else."""
    ranked = F.when(level == LEVELS[0], 0)
    for i, name in enumerate(LEVELS[1:], start=1):
        ranked = ranked.when(level == name, i)
    return ranked


def levels_from(minimum: str) -> list[str]:
    """An unknown minimum is reached by no level."""
    return list(LEVELS[LEVELS.index(minimum) :]) if minimum in LEVELS else []


def at_least(level: Column, minimum: str) -> Column:
    """A membership test, so the filter reaches the scan."""
    wanted = levels_from(minimum)
    return level.isin(wanted) if wanted else F.lit(False)
