"""Tail probabilities for the handful of test statistics a query ends in.

NumPy only, vectorised, used through Arrow on result rows (one per test, not per data row).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_TINY = 1e-300


def _steps(*sizes) -> int:
    """Terms that are enough for parameters of these sizes: they grow with the square root."""
    return 1000 + 60 * math.isqrt(int(max((np.nanmax(np.abs(s), initial=0.0) for s in sizes), default=0.0)))


def _continued(b0, terms, steps: int):
    """Lentz evaluation of b0 + a1/(b1 + a2/(b2 + ...)) with ``terms(i) -> (a_i, b_i)``; runs to convergence."""
    f = np.where(b0 == 0, _TINY, b0)
    c, d = f.copy(), np.zeros_like(f)
    for i in range(1, steps + 1):
        a, b = terms(i)
        d = b + a * d
        d = 1 / np.where(d == 0, _TINY, d)
        c = b + a / c
        c = np.where(c == 0, _TINY, c)
        step = c * d
        f = f * step
        if np.nanmax(np.abs(step - 1), initial=0.0) < 1e-14:
            return f
    raise ArithmeticError("continued fraction did not converge")


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)

    def terms(i):
        if i == 1:
            return np.ones_like(y), np.ones_like(y)
        n = i - 1
        m = n // 2
        if n % 2:
            return -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(y)
        return m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(y)

    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) - np.log(p) - (_lgamma(p) + _lgamma(q) - _lgamma(p + q)))
        value = front * (_continued(np.zeros_like(y), terms, _steps(p, q)))
    value = np.where(y <= 0, 0.0, value)
    return np.where(swap, 1 - value, value)


def upper_gamma(a, x):
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.empty_like(x)
    low = x < a + 1
    if low.any():
        al, xl = a[low], x[low]
        term = 1 / al
        total = term.copy()
        for n in range(1, _steps(al)):
            term = term * xl / (al + n)
            total = total + term
            if (np.abs(term) <= np.abs(total) * 1e-16).all():
                break
        else:
            raise ArithmeticError("series did not converge")
        with np.errstate(divide="ignore"):
            out[low] = 1 - total * np.exp(-xl + al * np.log(xl) - _lgamma(al))
    if (~low).any():
        ah, xh = a[~low], x[~low]

        def terms(i):
            if i == 1:
                return np.ones_like(xh), xh + 1 - ah
            n = i - 1
            return -n * (n - ah), xh + 2 * n + 1 - ah

        out[~low] = np.exp(-xh + ah * np.log(xh) - _lgamma(ah)) * _continued(np.zeros_like(xh), terms, _steps(ah))
    return out


def t_two_sided(t, df):
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, dtype=float)) / math.sqrt(2))


def chi2_upper(x, dof):
    return upper_gamma(np.asarray(dof, dtype=float) / 2, np.asarray(x, dtype=float) / 2)


def count_upper(mu, var, k):
    """P(X >= k): negative binomial where ``var`` is given (above the mean), else Poisson."""
    mu, var, k = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(mu, var, k))
    out, wide, some = np.ones_like(mu), ~np.isnan(var), k > 0
    plain, over = some & ~wide, some & wide
    if plain.any():
        out[plain] = 1 - upper_gamma(k[plain], mu[plain])
    if over.any():
        m, v = mu[over], var[over]
        out[over] = incomplete_beta(k[over], m * m / (v - m), 1 - m / v)
    return out


def count_quantile(mu, var, level):
    """The least k with P(X <= k) >= level, by bisection."""
    mu, var, level = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(mu, var, level))
    spread = np.sqrt(np.maximum(np.where(np.isnan(var), mu, var), mu))
    low, high = np.full_like(mu, -1.0), np.ceil(mu + 12 * spread + 20)
    while (short := 1 - count_upper(mu, var, high + 1) < level).any():
        high = np.where(short, 2 * high, high)
    while (high - low > 1).any():
        mid = np.floor((low + high) / 2)
        enough = 1 - count_upper(mu, var, mid + 1) >= level
        high, low = np.where(enough, mid, high), np.where(enough, low, mid)
    return high


@F.pandas_udf(DoubleType())
def count_tail(mu: pd.Series, var: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(count_upper(mu.astype(float), var.astype(float), k.astype(float)))


@F.pandas_udf(DoubleType())
def count_limit(mu: pd.Series, var: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series(count_quantile(mu.astype(float), var.astype(float), level.astype(float)))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df))


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z))


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, dof))
