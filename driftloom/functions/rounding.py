"""Decimal rounding of doubles by their exact value, halves to even, as Python's ``round`` does.

Spark's ``round`` and ``bround`` go by the shortest decimal text of a double, in which 2.675 looks like a
tie although the double lies below it. Here a product's rounding error is computed beside it, so ties are
told exactly, in plain double arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1: cuts a double in two halves whose products are exact


def rounded(x: Column, digits: int = 0) -> Column:
    """``x`` to 0 to 15 decimal digits; null, NaN and infinities stay, and zeros have no sign."""
    if not 0 <= digits <= 15:
        raise ValueError("digits are from 0 to 15")
    x, scale = x.cast("double"), float(10**digits)
    scale_hi = _SPLIT * scale - (_SPLIT * scale - scale)
    scale_lo = scale - scale_hi
    hi = x * _SPLIT - (x * _SPLIT - x)
    lo = x - hi
    product = x * scale
    error = ((hi * scale_hi - product) + hi * scale_lo + lo * scale_hi) + lo * scale_lo
    below = F.floor(product).cast("double")
    past_half = (product - below - 0.5) + error  # its sign is exact
    even = F.pmod(below, F.lit(2.0)) == 0
    whole = (
        F.when(past_half > 0, below + 1)
        .when(past_half == 0, F.when(even, below).otherwise(below + 1))
        .when(past_half == -1, F.when(even, below).otherwise(below - 1))  # half a unit below a product that was rounded up
        .otherwise(below)
    )
    # From 2^53 units on, doubles lie further apart than the digits do.
    return F.when(F.abs(product) < float(1 << 53), whole / scale).otherwise(x)
