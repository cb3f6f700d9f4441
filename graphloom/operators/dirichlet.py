"""Dirichlet parameters: sampling and fixed-point fits from length histograms.

A fit needs only histograms, {count: how often}; these are aggregated by Spark and
have few rows, so the fixed point itself runs on the driver.
"""

from __future__ import annotations

import math

import numpy as np

TOLERANCE = 1e-4


def digamma(x: float) -> float:
    s = 0.0
    while x < 12:
        s -= 1 / x
        x += 1
    y = 1 / (x * x)
    return s + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def weighted_harmonic(histogram: dict[int, int], y: float) -> float:
    """Sum over n of histogram[n] * (1/y + 1/(y+1) + … + 1/(y+n-1))."""
    if y <= 0:
        return math.inf if any(n > 0 and c for n, c in histogram.items()) else 0.0
    base = digamma(y)
    return sum(c * (digamma(y + n) - base) for n, c in histogram.items() if n > 0)


def symmetric_step(param: float, dims: int, lengths: dict[int, int], cells: dict[int, int]) -> float:
    """One step for the sum ``param`` of ``dims`` equal parameters."""
    below = weighted_harmonic(lengths, param)
    return param / dims * weighted_harmonic(cells, param / dims) / below if below else param


def fit_symmetric(value: float, dims: int, lengths: dict[int, int], cells: dict[int, int], steps: int = 1000) -> float:
    """The parameter of one dimension; ``cells`` pools the counts of all dimensions."""
    param = value * dims
    for _ in range(steps):
        new = symmetric_step(param, dims, lengths, cells)
        if not new or abs(new - param) / new <= TOLERANCE:
            return new / dims
        param = new
    return param / dims


def fit(alpha: list[float], lengths: dict[int, int], cells: list[dict[int, int]], steps: int = 1000) -> list[float]:
    """Parameters of each dimension from the lengths of all groups and the dimension's own counts."""
    a = list(alpha)
    for _ in range(steps):
        below = weighted_harmonic(lengths, sum(a))
        new = [x * weighted_harmonic(c, x) / below if below else x for x, c in zip(a, cells)]
        change, whole = sum(abs(x - y) for x, y in zip(new, a)), sum(new)
        a = new
        if not whole or change / whole <= TOLERANCE:
            break
    return a


def gamma(rng: np.random.Generator, shape: float, scale: float = 1.0) -> float:
    return float(rng.gamma(shape, scale))


def dirichlet(rng: np.random.Generator, alpha: list[float] | float, dims: int | None = None) -> np.ndarray:
    """A draw with these parameters, or with ``dims`` equal ones."""
    a = np.full(dims, float(alpha)) if dims else np.asarray(alpha, float)
    g = rng.gamma(a, 1.0)
    s = g.sum()
    return g / s if s > 0 else np.eye(len(a))[rng.integers(len(a))]


def multinomial(rng: np.random.Generator, weights) -> int:
    """An index with probability in proportion to its weight."""
    c = np.cumsum(weights)
    return int(min(np.searchsorted(c, rng.random() * c[-1], side="right"), len(c) - 1))
