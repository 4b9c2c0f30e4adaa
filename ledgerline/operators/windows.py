"""Point-in-time windows over long team tables: only rows before the current one count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def last_n(keys: Sequence[str], order: Sequence[str], n: int) -> WindowSpec:
    """The n rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)


def before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def seconds_before(keys: Sequence[str], stamp: str, seconds: int) -> WindowSpec:
    """Rows whose time lies in [t - seconds, t)."""
    return Window.partitionBy(*keys).orderBy(epoch(stamp)).rangeBetween(-seconds, -1)


def epoch(stamp: str) -> Column:
    """Whole seconds of a timestamp (with or without zone, session zone UTC)."""
    return F.unix_seconds(F.col(stamp).cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000)


def folded(values: Column, alpha: float) -> Column:
    """Exponentially weighted average of an array, seeded with its first value; null for an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1).cast("double"), lambda a, x: a * (1 - alpha) + x * alpha))


def slope(value: Column, position: Column, window: WindowSpec, least: int = 3) -> Column:
    """Linear trend of value over the window, for least rows or more."""
    return F.when(F.count(value).over(window) >= least, F.regr_slope(value, position).over(window))
