"""Special functions as columns: a fixed number of terms, whatever the arguments, and no Python workers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ln x! less Stirling's x ln x - x + ln(2 pi x) / 2, exactly for 0 to 15 (0 at 0, where the formula has no value).
_SMALL = [0.0] + [math.lgamma(x + 1) - (x * math.log(x) - x + 0.5 * math.log(2 * math.pi * x)) for x in range(1, 16)]
#: Points and weights on stretches of 0 to 40, over which exp(-s) falls below what a double can tell from 0 beside 1.
_POINTS, _WEIGHTS = (np.concatenate(x).tolist() for x in zip(*((a + (b - a) * (p + 1) / 2, w * (b - a) / 2) for a, b in ((0, 0.05), (0.05, 0.15), (0.15, 0.4), (0.4, 1.0)) for p, w in (np.polynomial.legendre.leggauss(24),)), strict=True))


def stirling_error(x: Column) -> Column:
    """ln x! less Stirling's formula, of a whole number from 0."""
    d = x.cast("double")
    far = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (d * d)) / (d * d)) / (d * d)) / d
    return F.when(x < len(_SMALL), F.get(F.array(*map(F.lit, _SMALL)), x.cast("int"))).otherwise(far)


def log_factorial(x: Column) -> Column:
    d = F.greatest(x, F.lit(1)).cast("double")
    return F.when(x < 2, F.lit(0.0)).otherwise(d * F.ln(d) - d + F.ln(2 * math.pi * d) / 2 + stirling_error(x))


def log_half_binomial(n: Column, k: Column) -> Column:
    """ln of n over k divided by 2 ** n, from the deviance, so that large terms don't cancel (Loader's form)."""
    m, d = n.cast("double"), (2 * k - n).cast("double") / n.cast("double")
    deviance = m / 2 * ((1 + d) * F.log1p(d) + (1 - d) * F.log1p(-d))
    inner = stirling_error(n) - stirling_error(k) - stirling_error(n - k) - deviance - F.ln(2 * math.pi * k.cast("double") * (n - k).cast("double") / m) / 2
    return F.when((k == 0) | (k == n), -m * math.log(2)).otherwise(inner)


def half_binomial_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins, for 2 k <= n: the incomplete beta function at 1/2 by quadrature.

    The integrand is 1 at 1/2 and falls like exp(-(n - 2k - 1) t - n t^2 / 2) with the distance t / 2 from there; the
    points are dealt over 40 times that width, or to the end of the interval where it is nearer.
    """
    a, b = (n - k - 1).cast("double"), k.cast("double")
    end = F.least(F.lit(1.0), F.lit(40.0) / (F.greatest(a - b, F.lit(0.0)) + F.sqrt(n.cast("double")) + 1))
    points = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, w in zip(_POINTS, _WEIGHTS, strict=True)))
    height = lambda t: F.exp(a * F.log1p(-t) + b * F.log1p(t))
    area = F.aggregate(points, F.lit(0.0), lambda s, x: s + x["w"] * height(x["p"] * end)) * end
    return F.exp(log_half_binomial(n, k)) * (n - k).cast("double") * area
