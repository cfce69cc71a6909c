"""Severity levels, ordered from the least to the most serious."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Level names in rank order, and the spellings accepted on input.
LEVELS = ("WARNING", "MEDIUM", "HIGH", "CRITICAL")
SPELLINGS = {
    "WARNING": ("warning", "warn", "w"),
    "MEDIUM": ("medium", "med", "m"),
    "HIGH": ("high", "h"),
    "CRITICAL": ("critical", "crit", "c"),
}


def parse_severity(text: str) -> str:
    """Return the level named by ``text`` in any case, or raise ``ValueError``."""
    wanted = text.lower()
    for level, names in SPELLINGS.items():
        if wanted in names:
            return level
    raise ValueError(f"unknown severity {text!r}; expected one of {', '.join(LEVELS)}")


def rank_of(level: str) -> int:
    return LEVELS.index(level)


def severity_rank(level: Column) -> Column:
    """Rank 0..3 of a severity column, NULL for anything else."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)
    return F.when(pos > 0, pos - 1).cast("tinyint")
