"""Dashboard filter predicates.  Each returns a boolean Column, so filters
compose with `where` and push down to a Parquet scan of a stored dataset."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinel the age dropdowns use for "no bound" (a fixed value of the dashboard).
NO_AGE_BOUND = "None"


def _date(value: str | dt.date) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else F.lit(value)


def date_between(col: str, start: str | dt.date | None, end: str | dt.date | None) -> Column:
    """Inclusive day range; an open bound is skipped.  NULL days never pass."""
    c = F.col(col)
    cond = c.isNotNull()
    if start is not None:
        cond = cond & (c >= _date(start))
    if end is not None:
        cond = cond & (c <= _date(end))
    return cond


def text_between(col: str, low: str | None, high: str | None) -> Column:
    """Inclusive lexicographic range (platform, age label).  'Unknown' sorts
    above every digit, so '18-24'..'Unknown' keeps all labelled ages."""
    c = F.col(col)
    cond = c.isNotNull()
    if low is not None:
        cond = cond & (c >= F.lit(low))
    if high is not None:
        cond = cond & (c <= F.lit(high))
    return cond


def age_between_unless_unset(col: str, low: str, high: str) -> Column:
    """Age range applied only when neither bound is the 'None' sentinel."""
    if low == NO_AGE_BOUND or high == NO_AGE_BOUND:
        return F.lit(True)
    return text_between(col, low, high)


def age_between_null_tolerant(col: str, low: str, high: str) -> Column:
    """(age >= low OR age IS NULL) AND (age <= high OR age = 'Unknown').

    Net effect, kept as in the dashboard: NULL ages fail the second clause,
    and 'Unknown' always passes it."""
    c = F.col(col)
    return (((c >= F.lit(low)) | c.isNull()) & ((c <= F.lit(high)) | (c == F.lit("Unknown"))))


def at_least(**bounds: float) -> Column:
    """col >= bound for every keyword (slider minimums)."""
    cond = F.lit(True)
    for name, bound in bounds.items():
        cond = cond & (F.col(name) >= F.lit(bound))
    return cond


def at_most(**bounds: float) -> Column:
    cond = F.lit(True)
    for name, bound in bounds.items():
        cond = cond & (F.col(name) <= F.lit(bound))
    return cond
