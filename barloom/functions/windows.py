"""Trailing windows over one symbol's bars, with pandas-like warm-up: null until a window is full."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str | list = "bar_date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def symbol() -> WindowSpec:
    """One symbol's bars in order of date."""
    return by("symbol")


def last_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return (w or symbol()).rowsBetween(-(n - 1), 0)


def prior_n(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """The n rows before the current one."""
    return (w or symbol()).rowsBetween(-n, -1)


def up_to_now(w: WindowSpec | None = None) -> WindowSpec:
    return (w or symbol()).rowsBetween(Window.unboundedPreceding, 0)


def full(agg, x: Column, n: int, w: WindowSpec | None = None) -> Column:
    """``agg(x)`` over the last n rows, null unless all n values are there."""
    f = last_n(n, w)
    return F.when(F.count(x).over(f) == n, agg(x).over(f))


def lag(x: Column | str, k: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(x, k).over(w or symbol())


def nz(x: Column) -> Column:
    """Null in place of zero, for denominators."""
    return F.nullif(x, F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 or 0.0; a null condition is 0.0."""
    return F.coalesce(condition, F.lit(False)).cast("double")


def corr(x: Column, y: Column, n: int, w: WindowSpec | None = None) -> Column:
    """Pearson correlation over a full window; null if either side is constant."""
    f = last_n(n, w)
    bottom = F.stddev_samp(x).over(f) * F.stddev_samp(y).over(f)
    return F.when((F.count(x).over(f) == n) & (F.count(y).over(f) == n), F.covar_samp(x, y).over(f) / nz(bottom))


def zscore(x: Column, n: int, w: WindowSpec | None = None) -> Column:
    return (x - full(F.avg, x, n, w)) / nz(full(F.stddev_samp, x, n, w))


def average_rank(x: Column | str, *keys: str) -> Column:
    """Average rank of non-null values within ``keys``: the mean of the first and the last place of equal values, in one order."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / F.lit(2))


def pct_rank(x: Column | str, *keys: str) -> Column:
    """``average_rank`` over the number of values, from the same order: one sort a column."""
    x = F.col(x) if isinstance(x, str) else x
    whole = Window.partitionBy(*keys).orderBy(x.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return average_rank(x, *keys) / F.count(x).over(whole)


def rounded(df, digits: int = 6):
    """All double columns rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
