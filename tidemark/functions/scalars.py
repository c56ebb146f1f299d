"""Null- and NaN-safe scalar columns."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sum_of(cols: list[Column]) -> Column:
    """Sum across columns in which a null counts as 0."""
    return reduce(add, (F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))


def ratio(x: Column, y: Column) -> Column:
    """x / y; null where y is 0."""
    return F.try_divide(x, y)


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(x: Column) -> Column:
    """Infinite values become null; NaN stays."""
    return F.when(F.abs(x) != float("inf"), x)


def r6(x: Column) -> Column:
    """Rounded half up to six places by the same double arithmetic in any engine; -0.0 becomes 0.0."""
    return F.floor(x * 1e6 + 0.5) / 1e6 + 0.0


def quotient(x: Column, y: Column) -> Column:
    """x / y as floating point has it: a zero divisor gives an infinity, or NaN for 0 / 0; nulls stay null."""
    over_zero = F.when(x > 0, float("inf")).when(x < 0, float("-inf")).when(x == 0, float("nan"))
    return F.when(y != 0, F.try_divide(x, y)).when(y == 0, over_zero)


def r9(x: Column) -> Column:
    """Rounded half up to nine significant digits, for values of any size; what is infinite becomes null."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))).cast("double"))
    return F.when(x == 0, 0.0).when(F.abs(x) != float("inf"), F.floor(x / size * 1e8 + 0.5) / 1e8 * size)


def no_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows without a null in ``cols`` (all columns by default); NaN is a value and stays."""
    cols = cols or df.columns
    return df.where(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in cols))) if cols else df
