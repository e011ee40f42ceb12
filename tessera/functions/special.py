"""Tail probabilities of single statistics, from the incomplete beta and gamma functions.

For the few numbers of a fitted model; nothing here is meant for rows.
"""

from __future__ import annotations

import math


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / (df + t * t), df / 2, 0.5)


def f_upper(f: float, df1: float, df2: float) -> float:
    return beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_critical(level: float, df: float) -> float:
    """The t that a share of 1 - ``level`` exceeds on both sides, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - level else (low, mid)
    return (low + high) / 2


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    f = d
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or 1e-300)
        c = b + step / c or 1e-300
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * f


def chi2_upper(x: float, df: float) -> float:
    return 1 - gamma_share(df / 2, x / 2)


def kolmogorov_upper(d: float, n: float) -> float:
    """Of the greatest distance of n values from a distribution, scaled for small samples."""
    root = math.sqrt(n)
    reach = (root + 0.12 + 0.11 / root) * d
    total = sum(2 * (-1) ** (j - 1) * math.exp(-2 * j * j * reach * reach) for j in range(1, 101))
    return min(1.0, max(0.0, total)) if reach > 0.04 else 1.0
