"""Tails of the t and F distributions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
#: Steps of the continued fraction; it converges in far fewer for the arguments of the tests here.
STEPS = 120


def log_gamma(z: Column) -> Column:
    """For z > 0: moved up by eight, where Stirling's series is exact to double precision."""
    product = F.lit(1.0)
    for k in range(8):
        product = product * (z + k)
    w = z + 8
    series = sum((F.lit(c) / F.pow(w, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    return (w - 0.5) * F.ln(w) - w + 0.5 * math.log(2 * math.pi) + series - F.ln(product)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    one = F.lit(1.0)
    d0 = one / safe(one - (a + b) * x / (a + 1))
    start = F.struct(one.alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = one / safe(one + even * s["d"])
        c = safe(one + even / s["c"])
        h = s["h"] * c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d2 = one / safe(one + odd * d)
        c2 = safe(one + odd / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * c2 * d2).alias("h"))

    steps = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def regularized_beta(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for 0 <= x <= 1 and a, b > 0."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low, high = front * _fraction(x, a, b) / a, 1 - front * _fraction(1 - x, b, a) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return regularized_beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def t_tail(t: Column, df: Column) -> Column:
    """P(abs(T) > abs(t)) with df degrees of freedom."""
    return regularized_beta(df / (df + t * t), df / 2.0, F.lit(0.5))
