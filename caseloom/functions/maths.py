"""Scalar expressions: units, rounding, normal distribution, Student quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per unit; a year has 365 days.
UNIT_MS = {
    "nanoseconds": 1e-6,
    "microseconds": 1e-3,
    "milliseconds": 1.0,
    "seconds": 1000.0,
    "minutes": 60_000.0,
    "hours": 3_600_000.0,
    "days": 86_400_000.0,
    "weeks": 604_800_000.0,
    "years": 31_536_000_000.0,
}

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def epoch_ms(ts: Column | str) -> Column:
    return F.unix_millis(F.col(ts) if isinstance(ts, str) else ts)


def to_unit(millis: Column, unit: str) -> Column:
    """Milliseconds to another unit, as a double."""
    return millis.cast("double") / F.lit(UNIT_MS[unit])


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(x + 0.5)


def format_duration(millis: Column) -> Column:
    """``HH:MM:SS``; hours may pass 99."""
    seconds = F.floor(millis / 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("bigint"),
                           F.floor(seconds / 60).cast("bigint") % 60, seconds % 60)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / sd
    return F.exp(z * z * -0.5) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, absolute error below 1e-7."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (x * ERF_P + 1.0)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = F.lit(1.0) - poly * F.exp(-(x * x))
    return F.when(z >= 0, (erf + 1.0) * 0.5).otherwise((F.lit(1.0) - erf) * 0.5)


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return h


def _regularised_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(x, a, b) / a
    return 1.0 - front * _beta_fraction(1.0 - x, b, a) / b


def student_quantile(p: float, df: float) -> float:
    """Quantile of the t distribution for p >= 0.5, by bisection."""
    low, high = 0.0, 1.0

    def cdf(t: float) -> float:
        return 1.0 - 0.5 * _regularised_beta(df / (df + t * t), df / 2.0, 0.5)

    while cdf(high) < p:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if cdf(mid) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def student_quantile_column(p: float, df: Column) -> Column:
    """Quantile of the t distribution as an expression.

    Up to 30 degrees of freedom the value is looked up in an exact map; above,
    a Cornish-Fisher expansion around the normal quantile is used, whose error
    there is below 1e-5.
    """
    z = _normal_quantile(p)
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    small = F.create_map(*[F.lit(v) for n in range(1, 31) for v in (n, student_quantile(p, n))])
    n = df.cast("double")
    series = (F.lit(z) + F.lit(g1) / n + F.lit(g2) / (n * n) + F.lit(g3) / (n * n * n)
              + F.lit(g4) / (n * n * n * n))
    return F.when(df < 1, F.lit(None)).when(df <= 30, F.try_element_at(small, df.cast("int"))).otherwise(series)


def _normal_quantile(p: float) -> float:
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


normal_quantile = _normal_quantile
