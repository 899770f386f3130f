"""Numbers as C rounds them: the exact value of a double decides, not the shortest decimal that names it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """Two numbers of half the digits each whose sum is x, so products of them are exact."""
    far = x * 134217729.0  # 2 ** 27 + 1
    high = far - (far - x)
    return high, x - high


def rounded(x: Column, places: int = 0) -> Column:
    """x to so many decimal places (8 at most) as printf gives it; exact halves go to the even neighbour."""
    k, x = 10.0**places, x.cast("double")
    size = F.abs(x)
    high, low = _halves(size)
    n = F.floor(size * k).cast("double")
    over = (high * k - n - 0.5) + low * k  # how far the exact product lies above the half
    up = F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1.0).otherwise(0.0)
    near = F.when(x < 0, -1.0).otherwise(1.0) * (n + up) / k
    return F.when(size < 2.0**52 / k, near).otherwise(x)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded but once (up to cases that lie within 2 ** -100 of a half); not a number where a product is too large to split."""
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    rest = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    s = p + c
    part = s - p
    return s + ((p - (s - part)) + (c - part) + rest)
