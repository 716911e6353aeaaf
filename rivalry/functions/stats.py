"""Small-sample statistics as column expressions.

Intervals, verdicts and exact binomial tests are built-in expressions. Student-t
tails need the incomplete beta function, which no built-in offers; they run in a
Pandas UDF on already aggregated rows (a few dozen at most).
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# the few UDFs of this module travel by value, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def clip(c: Column, eps: float) -> Column:
    # greatest/least skip NULLs: an unknown probability must stay unknown
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1 - eps)), F.lit(eps)))


def log_loss(p: Column, y: Column, eps: float) -> Column:
    q = clip(p, eps)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))


def wilson(wins: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, inside [0, 1]; NULL for an empty bin."""
    rate = wins / F.nullif(n, F.lit(0))
    z2 = z * z
    denom = 1 + z2 / F.nullif(n, F.lit(0))
    centre = rate + z2 / (2 * F.nullif(n, F.lit(0)))
    half = z * F.sqrt((rate * (1 - rate) + z2 / (4 * F.nullif(n, F.lit(0)))) / F.nullif(n, F.lit(0)))
    low = F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / denom))
    return low, F.when(n > 0, F.least(F.lit(1.0), (centre + half) / denom))


def verdict(n: Column, error: Column, p_value: Column) -> Column:
    return (F.when(n < 20, "Low sample").when(error.isNull() | p_value.isNull(), "No signal")
            .when(p_value < 0.01, "Strong warning").when(p_value < 0.05, "Suspicious")
            .when(F.abs(error) >= 0.08, "Watch").otherwise("Looks OK"))


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lg = np.vectorize(math.lgamma, otypes=[float])
    return lg(a) + lg(b) - lg(a + b)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), by Gauss-Legendre panels on a substituted integral.

    With u = arcsin(sqrt(t)) the integrand 2 sin^(2a-1) cos^(2b-1) is smooth; panels
    are laid around the mode so that narrow peaks stay resolved.
    """
    nodes, weights = np.polynomial.legendre.leggauss(40)
    out = np.empty(len(x))
    for i, (xi, ai, bi) in enumerate(zip(x, a, b)):
        if not np.isfinite(xi + ai + bi):
            out[i] = np.nan
            continue
        upper = math.asin(math.sqrt(min(max(xi, 0.0), 1.0)))
        mode = math.atan2(math.sqrt(max(2 * ai - 1, 1e-9)), math.sqrt(max(2 * bi - 1, 1e-9)))
        width = 1.0 / math.sqrt(2 * (ai + bi))
        cuts = [0.0, *[mode + k * width for k in range(-24, 25, 2)], math.pi / 2]
        edges = np.unique(np.clip(np.array(cuts), 0.0, upper))
        lo, hi = edges[:-1, None], edges[1:, None]
        u = (lo + hi) / 2 + (hi - lo) / 2 * nodes[None, :]
        with np.errstate(divide="ignore"):
            logf = (2 * ai - 1) * np.log(np.sin(u)) + (2 * bi - 1) * np.log(np.cos(u))
        area = float((2 * np.exp(logf - _log_beta(np.array([ai]), np.array([bi]))[0]) * (hi - lo) / 2 * weights).sum()) if len(edges) > 1 else 0.0
        out[i] = min(max(area, 0.0), 1.0)
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t) of Student's t."""
    half = 0.5 * incomplete_beta(df / (df + t * t), df / 2, np.full(len(t), 0.5))
    return np.where(t >= 0, half, 1 - half)


@F.pandas_udf(DoubleType())
def upper_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_tail(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def two_sided_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2 * t_tail(np.abs(t.to_numpy(float)), df.to_numpy(float)))


def binomial_two_sided(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact two-sided binomial p-value: mass of outcomes no likelier than the observed one.

    On each side of the mode the mass function is monotone, so the far tail starts at
    a point found by bisection and both tails are incomplete-beta values. The cost
    is logarithmic in n, whatever the bin size.
    """
    def log_pmf(j, nn, pp):
        return math.lgamma(nn + 1) - math.lgamma(j + 1) - math.lgamma(nn - j + 1) + j * math.log(pp) + (nn - j) * math.log1p(-pp)

    def below(j, nn, pp):  # P(X <= j)
        if j < 0:
            return 0.0
        if j >= nn:
            return 1.0
        return float(incomplete_beta(np.array([1 - pp]), np.array([float(nn - j)]), np.array([float(j + 1)]))[0])

    out = []
    for kk, nn, pp in zip(k, n, p):
        if not np.isfinite(kk + nn + pp) or nn <= 0 or not 0 < pp < 1:
            out.append(np.nan)
            continue
        kk, nn = int(kk), int(nn)
        mean = nn * pp
        if kk == mean:
            out.append(1.0)
            continue
        limit = log_pmf(kk, nn, pp) + 1e-7
        if kk < mean:  # smallest j above the mean with pmf <= pmf(k)
            lo, hi = math.ceil(mean), nn + 1
            while lo < hi:
                mid = (lo + hi) // 2
                if mid > nn or log_pmf(mid, nn, pp) <= limit:
                    hi = mid
                else:
                    lo = mid + 1
            value = below(kk, nn, pp) + 1 - below(lo - 1, nn, pp)
        else:  # greatest j below the mean with pmf <= pmf(k)
            lo, hi = -1, math.floor(mean)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if mid < 0 or log_pmf(mid, nn, pp) <= limit:
                    lo = mid
                else:
                    hi = mid - 1
            value = below(lo, nn, pp) + 1 - below(kk - 1, nn, pp)
        out.append(min(1.0, value))
    return np.array(out)


@F.pandas_udf(DoubleType())
def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_two_sided(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))
