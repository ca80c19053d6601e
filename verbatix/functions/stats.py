"""Rates, intervals and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points by severity, for issues, candidates and judged errors.
ISSUE_POINTS = {"critical": 12.0, "major": 5.0, "minor": 1.5, "info": 0.0}
CANDIDATE_POINTS = {"critical": 100.0, "major": 10.0, "minor": 1.0, "info": 0.0}
JUDGE_POINTS = {"Neutral": 0.0, "Minor": 1.0, "Major": 5.0, "Critical": 25.0}


def points(severity: Column, table: dict[str, float], other: float = 1.0) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(severity == name, value) if out is None else out.when(severity == name, value)
    return out.otherwise(other)


def safe_rate(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share, within 0 and 1; both 0 for an empty sample."""
    k, m = successes.cast("double"), F.greatest(n, F.lit(1)).cast("double")
    p, d = k / m, 1 + z * z / m
    mid = (p + z * z / (2 * m)) / d
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    low, high = F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def dashboard(rate_per_1000: Column, factor: float = 1.0) -> Column:
    """100 minus the error rate, not below 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - rate_per_1000 * factor)
