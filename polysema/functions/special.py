"""Special functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series ten steps up, and the steps back."""
    z = z.cast("double")
    y = z + 10
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    steps = F.lit(1.0)
    for k in range(10):
        steps = steps * (z + k)
    # the product of ten factors stays in range up to z = 1e30
    return series - F.ln(steps)


def _fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, so many steps."""
    tiny = 1e-300

    def kept(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    start = F.struct(F.lit(1.0).alias("c"), (1 / kept(1 - (a + b) * x / (a + 1))).alias("d"), (1 / kept(1 - (a + b) * x / (a + 1))).alias("h"))

    def half(s: Column, coefficient: Column) -> Column:
        d, c = 1 / kept(1 + coefficient * s["d"]), kept(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # each half is named once, else its value would be computed for every use
        first = F.transform(F.array(half(s, even)), lambda t: half(t, odd))
        return first[0]

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def binomial_tail(n: Column, m: Column) -> Column:
    """P(X <= m) of n fair coins, 2 m <= n: the regularised incomplete beta function I(n - m, m + 1) at one half.

    The fraction needs a multiple of the root of n in steps: 16,000 at ten million coins, 8 bytes each."""
    a, b, half = (n - m).cast("double"), (m + 1).cast("double"), F.lit(0.5)
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) - (a + b) * math.log(2.0)) / a
    return front * _fraction(a, b, half, (50 + 5 * F.sqrt(n.cast("double"))).cast("int"))


def binomial_share(n: Column, m: Column) -> Column:
    """P(X = m) of n fair coins."""
    return F.exp(ln_gamma(n + 1) - ln_gamma(m + 1) - ln_gamma(n - m + 1) - n.cast("double") * math.log(2.0))
