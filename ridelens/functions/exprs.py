"""Column expressions shared by the operators.  All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is exact: source doubles become DECIMAL(28,8) before any arithmetic, so
# sub-cent amounts count and only results are rounded.  Under ANSI mode an
# amount of 10^20 or more is an error, not a silent NULL.
USD = "decimal(28,8)"
# Wide enough for exact HALF_UP division of any realistic sum by any count.
_WIDE = "decimal(20,0)"


def usd(c: Column | str) -> Column:
    return F.col(c).cast(USD) if isinstance(c, str) else c.cast(USD)


def day(ts: Column | str) -> Column:
    """Calendar day of a zone-less timestamp (the source formats it YYYY-MM-DD)."""
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL (never raises)."""
    return num.cast("double") / F.nullif(den, F.lit(0)).cast("double")


def round_half_up_ratio(num: Column, den: Column, digits: int,
                        as_double: bool = True) -> Column:
    """round(num / den, digits) with HALF_UP on the exact quotient, as DOUBLE.

    `num` and `den` are integral.  Division runs on DECIMAL(20,0) operands so the
    quotient keeps 18 fractional digits; rounding it is exact for any count
    below 10^15.  (Rounding a DOUBLE mean instead flips x.xx5 boundaries.)"""
    q = num.cast(_WIDE) / F.nullif(den, F.lit(0)).cast(_WIDE)
    rounded = F.round(q, digits)
    return rounded.cast("double") if as_double else rounded.cast(f"decimal(20,{digits})")


def mean_of_means(c: Column | str, digits: int) -> Column:
    """Aggregate: HALF_UP-rounded unweighted mean of DOUBLE means, each taken to
    10 decimals.  Sums are integral, so the result depends neither on the order
    of rows nor on the partitioning."""
    col = F.col(c) if isinstance(c, str) else c
    return mean_half_up(col.cast("decimal(20,10)"), digits, scale=10)


def mean_half_up(c: Column, digits: int, scale: int = 0) -> Column:
    """Aggregate: HALF_UP-rounded mean of `c` (values with `scale` decimals)."""
    if scale:
        as_int = (c * (10 ** scale)).cast("decimal(38,0)")
        return round_half_up_ratio(F.sum(as_int), F.count(c) * (10 ** scale), digits)
    return round_half_up_ratio(F.sum(c.cast("bigint")), F.count(c), digits)


def age_sort_key(c: Column | str) -> Column:
    """Lower bound of an age label ('25-34' -> 25); NULL for 'Unknown' etc."""
    col = F.col(c) if isinstance(c, str) else c
    return F.split_part(col, F.lit("-"), F.lit(1)).try_cast("int")
