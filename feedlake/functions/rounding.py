"""Decimal rounding of doubles by their exact binary value, half to even.

``round`` and ``bround`` go through the shortest decimal text of a double, so they see
0.575 as a tie although the stored value lies below it. Here the distance to the tie is
computed without rounding error: the value is split into a short high part and a low
part, each of which the scale multiplies exactly, so the sign of the sum is the sign of
the true distance.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPLIT = float(2 ** 20)


def round_exact(x: Column, digits: int = 2) -> Column:
    """``x`` occurs several times: pass a column or something cheap."""
    scale = float(10 ** digits)
    x = x.cast("double")
    size = F.abs(x)
    high = F.floor(size * F.lit(_SPLIT)).cast("double") / F.lit(_SPLIT)
    base = F.floor(size * F.lit(scale)).cast("double")
    off = (high * F.lit(scale) - base - F.lit(0.5)) + (size - high) * F.lit(scale)
    up = F.when(off > 0, F.lit(1.0)).when(off < 0, F.lit(0.0)).otherwise(F.pmod(base, F.lit(2.0)))
    return F.when(x < 0, -1.0).otherwise(1.0) * ((base + up) / F.lit(scale))
