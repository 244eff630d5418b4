"""Numbers as texts show them (M6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALVES = 134217729.0  # 2 ** 27 + 1 splits a double in two of 26 bits


def _split(x: Column) -> tuple[Column, Column]:
    big = x * _HALVES
    high = big - (big - x)
    return high, x - high


def to_fixed(x: Column, digits: int = 4) -> Column:
    """A double rounded to digits after the point by its exact value, ties away from 0; for products with 10 ** digits below 2 ** 52.

    A rounding by the shortest decimal of a double takes 1.00005 for a tie, though it is less. What the product with the power of ten
    loses is computed from halves of the factors, and decides where the product by itself is a tie.
    """
    power = float(10**digits)
    a, b = F.abs(x), F.lit(power)
    product = a * b
    (ah, al), (bh, bl) = _split(a), _split(b)
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    below = F.floor(product)
    beyond = product - below - 0.5
    up = (beyond > 0) | ((beyond == 0) & (lost >= 0))
    whole = below.cast("double") + up.cast("double")
    return F.when(x < 0, -whole / power).otherwise(whole / power)
