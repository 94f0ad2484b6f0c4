"""Counts of a given mean: how likely they are up to a number, and the numbers that hold a given share."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function: by its series below a + 1, by its continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, np.float64), np.asarray(x, np.float64))
    out = np.ones(a.shape)
    some = x > 0
    scale = np.zeros(a.shape)
    scale[some] = np.exp(a[some] * np.log(x[some]) - x[some] - _log_gamma(a[some]).astype(np.float64))
    low = some & (x < a + 1)
    if low.any():
        n, term = a[low].copy(), 1 / a[low]
        total = term.copy()
        while (term > total * 1e-16).any():
            n += 1
            term *= x[low] / n
            total += term
        out[low] = 1 - scale[low] * total
    high = some & ~low
    if high.any():
        # by continuants, each step scaled so that none overflows
        b = x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h, k = d.copy(), 0
        while True:
            k += 1
            step = -k * (k - a[high])
            b += 2
            d = step * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + step / c
            c = np.where(c == 0, 1e-300, c)
            h *= d * c
            if (np.abs(d * c - 1) < 1e-14).all():
                break
        out[high] = scale[high] * h
    return out


def quantile(share: float, mean: np.ndarray) -> np.ndarray:
    """The least count up to which at least ``share`` of a Poisson distribution lies, by halving between two counts that enclose it."""
    mean = np.asarray(mean, np.float64)
    enough = lambda k: (k >= 0) & (gamma_upper(np.maximum(k, 0) + 1, mean) >= share)
    low, width = np.full(mean.shape, -1.0), np.ceil(4 * np.sqrt(mean)) + 4
    high = np.floor(mean) + width
    low = np.maximum(low, np.floor(mean) - width)
    while (wrong := enough(low)).any():
        low[wrong] = np.maximum(-1, low[wrong] - width[wrong])
    while (wrong := ~enough(high)).any():
        high[wrong] += width[wrong]
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        yes = enough(middle)
        high, low = np.where(yes, middle, high), np.where(yes, low, middle)
    return high


def interval(mean: Column, share: float) -> Column:
    """(low, high): the counts that cut off equal shares on both sides; null for a mean that is none or below 0."""

    @F.pandas_udf("low double, high double")
    def f(column: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"low": np.full(len(column), np.nan), "high": np.full(len(column), np.nan)})
        x = column.to_numpy(np.float64)
        means, where = np.unique(x[x >= 0], return_inverse=True)
        for name, q in (("low", (1 - share) / 2), ("high", (1 + share) / 2)):
            out.loc[x >= 0, name] = quantile(q, means)[where]
        return out.astype(object).where(out.notna(), None)

    return f(mean)
