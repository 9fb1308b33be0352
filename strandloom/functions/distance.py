"""Distances between two vectors held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column | str, b: Column | str, f, zero) -> Column:
    return F.aggregate(F.zip_with(a, b, f), zero, lambda x, y: x + y)


def l1(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute differences; on rank vectors this is Spearman's footrule."""
    return _sum(a, b, lambda x, y: F.abs(x - y).cast("double"), F.lit(0.0))


footrule = l1


def squared_euclid(a: Column | str, b: Column | str) -> Column:
    return _sum(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"), F.lit(0.0))


def root_sum(a: Column | str, b: Column | str, root: int) -> Column:
    """Sum of the differences' roots of degree 2, 3 or 4."""
    return _sum(a, b, lambda x, y: F.pow(F.abs(x - y).cast("double"), F.lit(1.0 / root)), F.lit(0.0))
