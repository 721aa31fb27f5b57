"""Scalar column expressions: clips, decibels, gates and confidence bounds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WILSON_Z = 1.959963984540054
FLOAT_EPS = 2.220446049250313e-16
EPS = 1.0e-8


def d(value: float) -> Column:
    """A double literal (a bare decimal literal would make Spark compute in DECIMAL)."""
    return F.lit(float(value))


def r6(value: Column, places: int = 6) -> Column:
    """Round for cross-engine comparison; adding 0.0 removes negative zero."""
    return F.round(value, places) + d(0.0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(d(low), F.least(d(high), value))


def decibels(power: Column, eps: float) -> Column:
    return d(10.0) * F.log10(F.greatest(power, d(eps)))


def sigmoid(logit: Column) -> Column:
    return d(1.0) / (d(1.0) + F.exp(-clip(logit, -40.0, 40.0)))


def hz_to_mel(hz: Column) -> Column:
    return d(2595.0) * F.log10(d(1.0) + hz / d(700.0))


def mel_to_hz(mel: Column) -> Column:
    return d(700.0) * (F.pow(d(10.0), mel / d(2595.0)) - d(1.0))


def bin_frequency(bin_: Column, sample_rate: Column, n_fft: int) -> Column:
    return bin_.cast("double") * sample_rate.cast("double") / d(n_fft)


def bounded_growth(value: Column) -> Column:
    """x / (1 + max(x, 0)) clipped to [0, 1]."""
    return clip(value / (d(1.0) + F.greatest(value, d(0.0))), 0.0, 1.0)


def risk_score(leakage: Column, instability: Column, drift: Column) -> Column:
    return F.greatest(clip(leakage, 0.0, 1.0), bounded_growth(instability), bounded_growth(drift))


def wilson_upper(successes: Column, trials: Column, z: float = WILSON_Z) -> Column:
    n = trials.cast("double")
    p = successes.cast("double") / n
    z2 = z * z
    centre = p + d(z2) / (d(2.0) * n)
    radius = d(z) * F.sqrt(p * (d(1.0) - p) / n + d(z2) / (d(4.0) * n * n))
    return F.when(trials > 0, clip((centre + radius) / (d(1.0) + d(z2) / n), 0.0, 1.0)).otherwise(d(1.0))


def student_t_two_sided(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation via the incomplete beta function."""
    if n < 3 or not math.isfinite(rho):
        return float("nan")
    if abs(rho) >= 1.0:
        return 0.0
    dof = n - 2
    x = 1.0 - rho * rho
    return _betainc(dof / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz evaluation)."""
    tiny = 1.0e-300
    c = 1.0
    denominator = 1.0 - (a + b) * x / (a + 1.0)
    frac = 1.0 / (denominator if abs(denominator) > tiny else tiny)
    total = frac
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            frac = 1.0 + step * frac
            frac = 1.0 / (frac if abs(frac) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * frac
        if abs(c * frac - 1.0) < 1.0e-15:
            break
    return total
