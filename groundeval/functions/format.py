"""Python-exact rounding of doubles (``'%.1f' % x``, ``round(x, 3)``) as native expressions.

Python rounds the exact binary value of ``x`` (ties to even); Java rounds its shortest decimal
string, so 3.55 (binary 3.5499999...) prints as '3.6' in Java and '3.5' in Python.  Here
``x * 10^digits`` is split into its rounded product ``p`` and the exact error ``e`` (Dekker's
two-product with a Veltkamp split; every step is exact in IEEE doubles), and only a product
landing exactly on ``.5`` consults ``e``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1


def _scaled(a: Column, factor: float) -> Column:
    """The whole number nearest to ``a * factor`` for ``a >= 0``, ties to even."""
    p = a * factor
    c = F.lit(_SPLIT) * a
    ah = c - (c - a)
    al = a - ah
    e = (ah * factor - p) + al * factor
    f = F.floor(p)
    d = p - f
    odd = (f % 2) == 1
    up = (d > 0.5) | ((d == 0.5) & ((e > 0) | ((e == 0) & odd)))
    return (f + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("long")


def round_half_even(x, digits: int = 3) -> Column:
    """Python's ``round(x, digits)`` for magnitudes below 10^9; null, NaN and infinities stay."""
    v = F.col(x) if isinstance(x, str) else x
    factor = float(10**digits)
    near = F.signum(v) * _scaled(F.abs(v), factor) / factor
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), v).otherwise(near)


def format_fixed1(x) -> Column:
    """Python's ``'%.1f' % x``."""
    v = F.col(x) if isinstance(x, str) else x
    a = F.abs(v)
    k = _scaled(a, 10.0)
    body = F.concat((k / 10).cast("long").cast("string"), F.lit("."), (k % 10).cast("string"))
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(v), F.lit("nan"))
        .when(a == float("inf"), F.concat(sign, F.lit("inf")))
        .otherwise(F.concat(sign, body))
    )
