"""Links of a binomial model: the mean and its slope for numpy in tasks, and the mean as SQL for scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import exp, lgamma, log

import numpy as np

#: A rational approximation of the normal distribution function (Hart's, to 15 digits), by falling powers.
_UPPER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_LOWER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_FAR = 7.07106781186547


def normal(x: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    a = np.minimum(np.abs(x), 37.0)
    near = np.polyval(_UPPER, a) / np.polyval(_LOWER, a)
    b = np.maximum(a, 1.0)
    far = 1 / (b + 1 / (b + 2 / (b + 3 / (b + 4 / (b + 0.65))))) / 2.506628274631
    tail = np.exp(-a * a / 2) * np.where(a < _FAR, near, far)
    return np.where(x > 0, 1 - tail, tail)


def _horner(powers: tuple[float, ...], x: str) -> str:
    out = f"{powers[0]!r}D"
    for p in powers[1:]:
        out = f"({out} * {x} + {p!r}D)"
    return out


def _normal_sql(eta: str) -> str:
    a = f"least(abs({eta}), 37.0D)"
    near = f"{_horner(_UPPER, a)} / {_horner(_LOWER, a)}"
    b = f"greatest({a}, 1.0D)"
    far = f"1 / ({b} + 1 / ({b} + 2 / ({b} + 3 / ({b} + 4 / ({b} + 0.65D))))) / 2.506628274631D"
    tail = f"exp(-{a} * {a} / 2) * CASE WHEN {a} < {_FAR}D THEN {near} ELSE {far} END"
    return f"CASE WHEN {eta} > 0 THEN 1 - {tail} ELSE {tail} END"


@dataclass(frozen=True)
class Link:
    """mean and slope: of the linear predictor; start: the predictor of a mean; sql: the mean of a predictor named in SQL."""

    mean: Callable[[np.ndarray], np.ndarray]
    slope: Callable[[np.ndarray], np.ndarray]
    start: Callable[[float], float]
    sql: Callable[[str], str]
    bounded: bool = False  # some predictors have no mean below 1


def _logistic(x):
    return np.where(x >= 0, 1 / (1 + np.exp(-np.abs(x))), np.exp(-np.abs(x)) / (1 + np.exp(-np.abs(x))))


def _probit_start(p: float) -> float:
    low, high = -8.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if normal(np.array([mid]))[0] < p else (low, mid)
    return (low + high) / 2


LINKS: dict[str, Link] = {
    "logit": Link(_logistic, lambda x: _logistic(x) * _logistic(-x), lambda p: float(np.log(p / (1 - p))), lambda e: f"1 / (1 + exp(-({e})))"),
    "probit": Link(normal, lambda x: np.exp(-np.minimum(x * x, 1400.0) / 2) / np.sqrt(2 * np.pi), _probit_start, _normal_sql),
    "cloglog": Link(lambda x: -np.expm1(-np.exp(np.minimum(x, 30.0))), lambda x: np.exp(np.minimum(x, 30.0) - np.exp(np.minimum(x, 30.0))), lambda p: float(np.log(-np.log1p(-p))), lambda e: f"-expm1(-exp(least({e}, 30.0D)))"),
    "cauchit": Link(lambda x: 0.5 + np.arctan(x) / np.pi, lambda x: 1 / (np.pi * (1 + x * x)), lambda p: float(np.tan(np.pi * (p - 0.5))), lambda e: f"0.5D + atan({e}) / pi()"),
    "log": Link(lambda x: np.exp(np.minimum(x, 700.0)), lambda x: np.exp(np.minimum(x, 700.0)), lambda p: float(np.log(p)), lambda e: f"least(exp({e}), 1.0D)", True),
}


def chi_squared_tail(x: float, freedom: float) -> float:
    """P(X >= x) of a chi-squared variable: the upper incomplete gamma function, by its series or continued fraction."""
    a, x = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    scale = exp(a * log(x) - x - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        g = -i * (i - a)
        b += 2
        d = 1 / (g * d + b)
        c = b + g / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h
