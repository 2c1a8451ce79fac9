"""Seeded random draws as vectorised column functions.

Every draw is the quantile of a uniform number that is a hash of the row's key
(``unit_hash``), so results do not depend on partitioning, order or retries.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A gamma of a larger shape is tabled around its mean and in logarithms: powers of that shape overflow.
NARROW = 120


@lru_cache(maxsize=32)
def _beta_table(a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(0.0, 1.0, 20_001)
    inner = np.clip(x, 1e-12, 1 - 1e-12)
    density = np.exp((a - 1) * np.log(inner) + (b - 1) * np.log1p(-inner))
    cdf = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return cdf / cdf[-1], x


@lru_cache(maxsize=32)
def _gamma_table(shape: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    top = shape + 12 * np.sqrt(shape) + 40
    if shape > NARROW:
        x = np.linspace(max(0.0, shape - 12 * np.sqrt(shape)), top, 40_000)
        middle = (x[1:] + x[:-1]) / 2
        logs = (shape - 1) * np.log(middle / shape) - (middle - shape)
        cdf = np.concatenate([[0.0], np.cumsum(np.exp(logs - logs.max()))])
        return cdf / cdf[-1], x * scale
    x = np.concatenate([[0.0], np.geomspace(1e-9, top, 40_000)])
    # substituting y = x**shape removes the pole at 0 for shapes below 1
    mass = np.exp(-(x[1:] + x[:-1]) / 2) * np.diff(x ** shape)
    cdf = np.concatenate([[0.0], np.cumsum(mass)])
    return cdf / cdf[-1], x * scale


def beta_quantiles(u: np.ndarray, a: float, b: float) -> np.ndarray:
    return np.interp(u, *_beta_table(a, b))


def gamma_quantiles(u: np.ndarray, shape: float, scale: float) -> np.ndarray:
    return np.interp(u, *_gamma_table(shape, scale))


def beta_draw(u: Column, a: float, b: float) -> Column:
    @F.pandas_udf("double")
    def draw(values: pd.Series) -> pd.Series:
        return pd.Series(beta_quantiles(values.to_numpy(), a, b))

    return draw(u)


def digamma(x: float) -> float:
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    y = 1 / (x * x)
    return total + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def gamma_shape(mean: float, mean_log: float) -> float:
    """Maximum-likelihood shape (location 0): log k - digamma(k) = log mean - mean log."""
    gap = np.log(mean) - mean_log
    if gap < 1e-4:  # 1 / 2k + 1 / 12k^2, to 13 digits: differences of digammas that near each other are noise
        return float((6 + np.sqrt(36 + 48 * gap)) / (24 * gap))
    k = (3 - gap + np.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        h = k * 1e-6
        slope = (np.log((k + h) / (k - h)) - digamma(k + h) + digamma(k - h)) / (2 * h)
        step = (np.log(k) - digamma(k) - gap) / slope
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return float(k)

