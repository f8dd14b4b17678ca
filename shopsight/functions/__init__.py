"""Scalar helpers, all built-in Spark expressions (JVM side, inside codegen).

Naming follows the warehouse dialect the marts were specified in; each helper is
a one-line composition of ``pyspark.sql.functions``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_days(start: ColumnOrName, end: ColumnOrName) -> Column:
    """timestamp_diff(end, start, day): whole 24-hour units, truncated toward zero.

    Taken from the day-time interval ``end - start`` of two timestamp_ntz
    values, so the result does not depend on the session time zone.
    """
    return F.extract(F.lit("DAY"), _c(end) - _c(start)).cast(T.LongType())


def calendar_days(end: ColumnOrName, start: ColumnOrName) -> Column:
    """date_diff(end, start, day): calendar-day boundaries between two dates."""
    return F.datediff(_c(end), _c(start)).cast(T.LongType())


def month_start(d: ColumnOrName) -> Column:
    """date_trunc(d, month) as a DATE."""
    return F.trunc(_c(d), "MM")


def months_between_starts(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """date_diff(later, earlier, month) for two month starts (an exact integer)."""
    return F.months_between(_c(later), _c(earlier)).cast(T.LongType())


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """NULL instead of an error when the divisor is 0 (ANSI mode is on)."""
    return F.try_divide(_c(a).cast(T.DoubleType()), _c(b).cast(T.DoubleType()))


def money_sum(c: ColumnOrName) -> Column:
    """Exact sum of a money column, at the scale of its source (for intermediate tables)."""
    return F.sum(_c(c))


def exact_sum(c: ColumnOrName) -> Column:
    """Exact sum of a money column, converted to double once at the end (order-free)."""
    return F.sum(_c(c)).cast(T.DoubleType())


def exact_avg(c: ColumnOrName) -> Column:
    """Mean as CAST(SUM AS DOUBLE) / COUNT: exact sum, one rounding."""
    return F.try_divide(F.sum(_c(c)).cast(T.DoubleType()), F.count(_c(c)).cast(T.DoubleType()))


def true_as_int(c: ColumnOrName) -> Column:
    """eq(True).astype(int): NULL and False both become 0."""
    return F.coalesce(_c(c), F.lit(False)).cast(T.IntegerType())


def bool_rate(c: ColumnOrName) -> Column:
    """Share of True among non-NULL values."""
    return F.try_divide(F.count_if(_c(c)).cast(T.DoubleType()), F.count(_c(c)).cast(T.DoubleType()))


def clip(c: ColumnOrName, lo=None, hi=None) -> Column:
    out = _c(c)
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return out
