"""Scalar column functions on numbers that keep NULL as the one sign of a missing value."""

from pyspark.sql import functions as F


def clip(x, low, high):
    """x within [low, high]; NULL stays NULL (bare least and greatest would give the bound)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a, b):
    """a / b, NULL where b is 0 or missing."""
    return F.try_divide(a, b)


def half_even(x, decimals: int):
    """Rounding of the scaled value to the nearest even number, as numpy does."""
    scale = float(10**decimals)
    return F.rint(x * scale) / scale


def r6(x):
    return F.round(x.cast("double"), 6)


def steady_sum(x):
    """Sum of doubles that doesn't depend on the order of rows: parts in whole 1024ths add without rounding (up to 2^43 in all), and what is
    left of a row is below 2^-10, so its sum's rounding stays far below the last bit of the total."""
    whole = F.rint(x * 1024) / 1024
    return F.sum(whole) + F.sum(x - whole)
