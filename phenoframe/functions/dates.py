"""Calendar functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenoframe.functions.text import col


def months(offset: str) -> int:
    """Months in an offset like 6mo, -18mo, 1y."""
    m = re.fullmatch(r"([+-]?\d+)\s*(mo|y)", offset.strip())
    if not m:
        raise ValueError(f"not an offset of months or years: {offset!r}")
    return int(m[1]) * (12 if m[2] == "y" else 1)


def shift(c: Column | str, offset: str) -> Column:
    """A date shifted by calendar months or years; the last day of a shorter month where the day does not exist."""
    return F.add_months(col(c).cast("date"), months(offset))


def year_age(born: Column | str, at: Column | str) -> Column:
    """Difference of the calendar years, which is not the exact age."""
    return F.year(col(at)) - F.year(col(born))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))
