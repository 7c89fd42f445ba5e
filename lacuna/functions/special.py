"""Distribution functions needed by the hypothesis tests, from published series and integrals."""

from __future__ import annotations

import math

import numpy as np


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi-squared: the regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, x = k / 2, x / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, h * scale)


def studentized_range_sf(q: float, k: int) -> float:
    """Upper tail of the studentised range of k groups with infinite degrees of freedom."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8 + q, 8001)
    pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    shifted = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z - q])
    y = k * pdf * (cdf - shifted) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - np.trapezoid(y, z))))


def wilcoxon_p(w: float, n: int, tie_term: float = 0.0, alternative: str = "two-sided", exact_below: int = 51) -> float:
    """P-value of the signed-rank sum W+ of n non-zero differences.

    Exact null distribution for small n without ties (``tie_term``: sum of t**3 - t), else the normal one.
    """
    if n == 0:
        return float("nan")
    top = n * (n + 1) // 2
    if n < exact_below and tie_term == 0 and float(w).is_integer():
        ways = np.zeros(top + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        p = ways / ways.sum()
        upper, lower = float(p[int(w):].sum()), float(p[: int(w) + 1].sum())
    else:
        sd = math.sqrt((n * (n + 1) * (2 * n + 1) - tie_term / 2) / 24)
        z = (w - top / 2) / sd if sd else 0.0
        upper, lower = norm_sf(z), norm_sf(-z)
    if alternative == "greater":
        return upper
    if alternative == "less":
        return lower
    return min(1.0, 2 * min(upper, lower))
