"""Statistical column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .strings import col


def ratio(a, b) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def share(condition: Column) -> Column:
    """Aggregate: part of the rows for which the condition holds (null counts as no)."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def wilson(k, n, z: float = V.WILSON_Z) -> Column:
    """Wilson score interval of k out of n as ``struct(low, high)``; (0, 0) for n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = F.try_divide(k, n)
    denom = 1 + F.try_divide(F.lit(z * z), n)
    center = (p + F.try_divide(F.lit(z * z), 2 * n)) / denom
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / denom
    zero = F.lit(0.0)
    return F.struct(
        F.when(n == 0, zero).otherwise(F.greatest(zero, center - half)).alias("low"),
        F.when(n == 0, zero).otherwise(F.least(F.lit(1.0), center + half)).alias("high"))


def fixed(c, digits: int) -> Column:
    """A number with a fixed count of digits, rounded half to even on its exact binary value.

    (``round`` and ``format_string`` round the shortest decimal form up, which differs on ties.)
    """
    return F.replace(F.format_number(col(c), digits), F.lit(","), F.lit(""))


def round_exact(c, digits: int) -> Column:
    """Rounding half to even on the exact binary value, as a double.

    Away from a tie scaling and rounding to a whole number gives the same, and much faster.
    """
    x, scale = col(c).cast("double"), float(10 ** digits)
    y = x * scale
    tie = F.abs(y - F.floor(y) - 0.5) < 1e-6
    return F.when(tie, fixed(x, digits).cast("double")).otherwise(F.rint(y) / scale)


def f1(precision, recall) -> Column:
    p, r = col(precision), col(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
