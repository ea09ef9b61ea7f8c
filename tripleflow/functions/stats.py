"""Upper tail of the F distribution, for the one-row result of a variance analysis."""

from __future__ import annotations

import math
from itertools import count

# The continued fraction converges in about sqrt(max(a, b)) steps at worst.
_MOST_STEPS = 100_000_000


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz method).

    ``y`` is 1 - x.  The first denominator, 1 - (a + b) x / (a + 1), is written with the
    smaller of the two, as it would cancel for x next to 1 and large ``a``.
    """
    tiny = 1e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0) if x < y else (1.0 - b + (a + b) * y) / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in count(1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coefficient / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
        if m == _MOST_STEPS:
            raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def _stirling_rest(z: float) -> float:
    """ln(z!) less Stirling's (z + 1/2) ln z - z + ln(2 pi) / 2, also where that is huge."""
    if z < 16:
        return math.lgamma(z + 1) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi)
    q = 1 / (z * z)
    return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / z


def _deviance(k: float, mean: float, gap: float) -> float:
    """k ln(k / mean) + mean - k, from the exact ``gap = k - mean`` where the two are close."""
    v = gap / (k + mean)
    if abs(v) > 0.1:
        return k * math.log(k / mean) - gap
    total, term = gap * v, 2 * k * v
    for j in count(1):
        term *= v * v
        larger = total + term / (2 * j + 1)
        if larger == total:
            return total
        total = larger


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 - x where that is known better.

    The leading factor is written with deviances from the mean, so no difference of huge
    logarithms is taken and no digits go as ``a`` or ``b`` grow.
    """
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    n = a + b
    gap = n * y - b if y < x else a - n * x  # a less its mean
    front = math.sqrt(a * b / (2 * math.pi * n)) * math.exp(
        _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b)
        - _deviance(a, n * x, gap) - _deviance(b, n * y, -gap)
    )
    if x < (a + 1.0) / (n + 2.0):
        return front * _beta_fraction(a, b, x, y) / a
    return 1.0 - front * _beta_fraction(b, a, y, x) / b


def f_upper_tail(f: float, df_between: float, df_within: float) -> float:
    """P(F > f) for the given degrees of freedom."""
    if f is None or math.isnan(f) or df_between <= 0 or df_within <= 0:
        return float("nan")
    if math.isinf(f):
        return 0.0
    whole = df_within + df_between * f
    return incomplete_beta(df_within / 2.0, df_between / 2.0, df_within / whole, df_between * f / whole)
