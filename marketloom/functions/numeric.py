"""Small column helpers shared by every operator."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def rnd(c: Column, digits: int) -> Column:
    """Half-up rounding in plain IEEE arithmetic, so any engine agrees bit for bit."""
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant table as a CASE expression: no join and nothing to broadcast."""
    expr = None
    for k, v in table.items():
        hit = key == F.lit(k)
        expr = F.when(hit, F.lit(v)) if expr is None else expr.when(hit, F.lit(v))
    return expr.otherwise(F.lit(default))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def nz(c: Column, value=0.0) -> Column:
    return F.coalesce(c, F.lit(value))


def f2(c: Column) -> Column:
    """Two-decimal text of a number, e.g. for alert bodies."""
    return F.format_string("%.2f", rnd(c, 2))


def f1(x: Column) -> Column:
    """One-decimal text of a number that is not negative, rounded by its exact binary value, ties to even, like printf."""
    tenths = F.floor(x * 10)
    # sign of 20 x - (2 tenths + 1): the rounding error of 16 x + 4 x is added back
    near = 16 * x + 4 * x
    gap = near - (2 * tenths + 1).cast("double") + (4 * x - (near - 16 * x))
    up = (gap > 0) | ((gap == 0) & (tenths % 2 == 1))
    return ((tenths + up.cast("long")).cast("decimal(20,0)") / F.lit(10).cast("decimal(2,0)")).cast("decimal(20,1)").cast("string")
