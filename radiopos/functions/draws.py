"""Seeded draws as Column expressions: the same rows get the same numbers in any order and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(seed: int, *parts: Column | str) -> Column:
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))


def uniform(seed: int, *parts: Column | str) -> Column:
    """Uniform in [0, 1): the first 52 bits of an md5."""
    return F.conv(F.substring(key(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def whole(seed: int, n: Column | int, *parts: Column | str) -> Column:
    """Uniform in 0 .. n - 1."""
    return F.floor(uniform(seed, *parts) * n).cast("long")


#: Coefficients of Acklam's rational approximation of the normal quantile, and where its tails begin.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL = 0.02425


def normal_quantile(share: Column) -> Column:
    """The standard normal value below which `share` of the values lie, to 1.2e-9 of itself."""

    def power(x: Column, of: tuple[float, ...]) -> Column:
        out = F.lit(of[0])
        for a in of[1:]:
            out = out * x + a
        return out

    def tail(p: Column) -> Column:
        q = F.sqrt(-2.0 * F.log(p))
        return power(q, _C) / (power(q, _D) * q + 1.0)

    q = share - 0.5
    middle = power(q * q, _A) * q / (power(q * q, _B) * (q * q) + 1.0)
    return F.when(share < _TAIL, tail(share)).when(share > 1 - _TAIL, -tail(1.0 - share)).otherwise(middle)


def normal(seed: int, *parts: Column | str) -> Column:
    """Standard normal, by Box-Muller."""
    u = 1 - uniform(seed, *parts, F.lit("u"))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(seed, *parts, F.lit("v")))
