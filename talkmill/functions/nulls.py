"""Comparisons with an explicit null policy."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def differs(a: Column, b: Column, null_differs: bool = True) -> Column:
    """``a != b`` with two values: a null on either side counts as different, or drops the row."""
    return ~F.coalesce(a == b, F.lit(False)) if null_differs else F.coalesce(a != b, F.lit(False))


def same(a: Column, b: Column) -> Column:
    """``a == b``; null equals nothing."""
    return F.coalesce(a == b, F.lit(False))


def not_in(a: Column, values: list) -> Column:
    """Not a member; null is not a member."""
    return F.coalesce(~a.isin(values), F.lit(True))


def nan_to_null(a: Column) -> Column:
    return F.when(F.isnan(a), None).otherwise(a)


def half_even(a: Column, digits: int) -> Column:
    """``a`` to so many decimals as figures are displayed: scaled, rounded with ties to even, scaled back, all in doubles."""
    return F.rint(a * F.lit(10.0**digits)) / F.lit(10.0**digits)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0))
