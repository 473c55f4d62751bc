"""Expressions over array columns and shift arithmetic, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(vec) -> Column:
    """The vector widened to double before any arithmetic."""
    return F.col(vec).cast("array<double>") if isinstance(vec, str) else vec.cast("array<double>")


def sum_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2(vec: Column) -> Column:
    """Unit-length vector; the epsilon keeps an all-zero vector at zero."""
    length = norm(vec) + F.lit(EPS)
    return F.transform(vec, lambda x: x / length)


def r6(value) -> Column:
    """Rounded to six digits, with negative zero folded into zero."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def modulo(value: Column, n) -> Column:
    """Non-negative remainder."""
    return F.pmod(value, F.lit(n))


def signed_shift(d: Column, n_windows: int) -> Column:
    """Rotation index 0..W-1 as a signed displacement, at most half a turn."""
    return F.when(d <= n_windows // 2, d).otherwise(d - n_windows)


def missing_to_null(value) -> Column:
    """NaN and infinities become NULL, which aggregates then skip."""
    c = F.col(value) if isinstance(value, str) else value
    odd = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(~odd, c)


def softmax(scores: Column) -> Column:
    """Probabilities from scores; NULL entries stay NULL and take no part."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0).cast("double"), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
    return F.transform(raised, lambda x: x / total)


def dot(a: Column, b: Column) -> Column:
    return sum_of(F.zip_with(a, b, lambda x, y: x * y))
