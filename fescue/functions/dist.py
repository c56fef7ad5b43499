"""Tail probabilities and quantiles for numbers on the driver."""

from __future__ import annotations

from math import erfc, exp, inf, isnan, lgamma, log, nan, sqrt


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * erfc(z / sqrt(2))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * f


def gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = an * d + b, b + an / c
        d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
        f *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * f


def t_p(t: float, df: float | None) -> float:
    """Two-sided p-value of Student's t, of the normal where df is None."""
    if isnan(t):
        return nan
    if df is None or df == inf:
        return 2 * normal_tail(abs(t))
    return beta_share(df / (df + t * t), df / 2, 0.5)


def f_p(f: float, df1: float, df2: float) -> float:
    return nan if isnan(f) else 1.0 if f <= 0 else beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)


def chi2_p(x: float, df: float) -> float:
    return nan if isnan(x) else gamma_tail(df / 2, x / 2)


def t_quantile(p: float, df: float | None) -> float:
    """x with P(T <= x) = p, by bisection; of the normal where df is None."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_p(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_p(mid, df) / 2 > 1 - p else (low, mid)
    return (low + high) / 2
