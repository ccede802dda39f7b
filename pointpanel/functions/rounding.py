"""Rounding for reported figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column | str, digits: int) -> Column:
    """Half-up in plain double arithmetic, so any engine repeating the three operations gets the same bits."""
    c = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.floor(c * scale + 0.5).cast("double") / scale


def half_even(value: Column | str, digits: int = 4) -> Column:
    """Banker's rounding, as reconciliation figures are reported."""
    return F.bround(value, digits)
