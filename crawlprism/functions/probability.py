"""p-values for frames with one row per test.

Spark has no erf, gamma or hypergeometric functions. The counts and ranks behind a test are
computed by Spark over the full data; only the closed-form tail of each finished row is here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def chi2_tail(x: float, dof: float) -> float:
    """P(X >= x) for chi-square: the regularised upper incomplete gamma Q(dof/2, x/2)."""
    if math.isnan(x) or math.isnan(dof) or dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, h = dof / 2.0, x / 2.0
    if dof == 1:
        return math.erfc(math.sqrt(h))
    scale = math.exp(a * math.log(h) - h - math.lgamma(a))
    if h < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = h + 1 - a
    c, d = 1 / tiny, 1 / b
    f = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        step = d * c
        f *= step
        if abs(step - 1) < 1e-15:
            return f * scale
    return math.nan  # no convergence: say so rather than give a rough value


def _stirling_rest(n: int) -> float:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    square = float(n) * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / (1188 * square)) / square) / square) / square) / n


def _deviance(x: int, mean: float, excess: float) -> float:
    """x ln(x / mean) - (x - mean), with x - mean given, so that nothing cancels near the mean."""
    if abs(excess) >= 0.1 * (x + mean):
        return x * math.log(x / mean) - excess
    v = excess / (x + mean)
    total, term, j = excess * v, 2 * x * v, 1
    while True:
        term *= v * v
        new = total + term / (2 * j + 1)
        if new == total:
            return total
        total, j = new, j + 1


def _log_binomial(x: int, n: int, k: int, of: int) -> float:
    """ln of the binomial probability of x in n at a rate of k / of, by deviances: it keeps its digits
    however large the counts are. The differences from the means are worked out in whole numbers."""
    if x == 0:
        return n * math.log1p(-k / of) if k < of else (0.0 if n == 0 else -math.inf)
    if x == n:
        return n * math.log(k / of)
    excess = (x * of - n * k) / of
    mean, rest = n * k / of, n * (of - k) / of
    return (
        _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, mean, excess) - _deviance(n - x, rest, -excess)
        + 0.5 * (math.log(n / x) - math.log(2 * math.pi * (n - x)))
    )


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the hypergeometric probabilities that do not exceed the observed one."""
    row, colm, n = a + b, a + c, a + b + c + d
    if n == 0 or row in (0, n) or colm in (0, n):
        return 1.0
    lo, hi = max(0, row + colm - n), min(row, colm)

    def logp(x: int) -> float:
        return _log_binomial(x, colm, row, n) + _log_binomial(row - x, n - colm, row, n) - _log_binomial(row, n, row, n)

    limit = logp(a) + 1e-7
    mode = min(max(((row + 1) * (colm + 1)) // (n + 2), lo), hi)

    def edge(inside: int, outside: int) -> int | None:
        """The point nearest the mode, between it and the end, whose probability is within limit."""
        if logp(outside) > limit:
            return None
        while abs(outside - inside) > 1:
            mid = (inside + outside) // 2
            if logp(mid) <= limit:
                outside = mid
            else:
                inside = mid
        return outside

    if logp(mode) <= limit:
        return 1.0

    def tail(start: int | None, step: int, end: int) -> float:
        if start is None:
            return 0.0
        total, x = 0.0, start
        while (end - x) * step >= 0:
            p = math.exp(logp(x))
            total += p
            if p <= total * 1e-18:
                break
            x += step
        return total

    return min(1.0, tail(edge(mode, lo), -1, lo) + tail(edge(mode, hi), 1, hi))


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p for tie-free samples, from the number of arrangements with each U.

    Only the tail is built: the coefficients of the Gaussian binomial up to the smaller U, as doubles.
    """
    m, n = min(n1, n2), max(n1, n2)
    size = n1 * n2 - math.ceil(max(u, n1 * n2 - u)) + 1
    counts = np.zeros(max(size, 0))
    counts[:1] = 1.0
    for i in range(1, m + 1):
        # Multiply by (1 - q^(n+i)), divide by (1 - q^i): a running sum in steps of i.
        if n + i < size:
            counts[n + i :] -= counts[: size - n - i].copy()
        padded = np.zeros(-(-size // i) * i)
        padded[:size] = counts
        counts = padded.reshape(-1, i).cumsum(axis=0).ravel()[:size]
    return min(1.0, 2 * float(counts.sum()) / math.comb(m + n, m))


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(v), float(k)) for v, k in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([min(1.0, math.erfc(float(v) / math.sqrt(2))) for v in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(
        [fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def mann_whitney_exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series(
        [mann_whitney_exact(float(v), int(a), int(b)) for v, a, b in zip(u, n1, n2)],
        dtype="float64",
    )
