"""Binomial regression over smooth and straight terms, with a penalty for each smooth term that the data choose.

Fisher scoring by penalised weighted least squares: a pass over the rows sums, in the tasks, the weighted products of
the design's columns (a matrix as large as the model), and the driver solves for the next coefficients. Between two
passes the smoothing parameters take Newton steps on their criterion for the working linear model:

    REML, ML   restricted or marginal likelihood of the terms seen as random effects, the scale being 1
    GCV.Cp     squared error plus twice the effective degrees of freedom (the scale is known, so Mallows' Cp)

P-REML and P-ML are the same here, as REML and ML are taken from the working model, too. A step that makes the
penalised deviance worse, or a mean reach 1 under the log link, is halved. Rows are read once for each pass; nothing
but sums leaves the tasks. A row may stand for several equal ones: it counts as often as its column _n says.

The penalty of a term is its basis' (see bases), scaled to the size of its columns and times its parameter. Smooth
columns sum to zero over the training rows; straight ones have mean 0 and deviation 1. `shrink` puts another penalty
on what a smooth's own leaves free, so that a term can vanish; `gamma` over 1 counts each degree of freedom so often.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bases
from .links import LINKS, Link, chi_squared_tail

#: Criteria that a model may ask for.
METHODS = ("GCV.Cp", "REML", "ML", "P-REML", "P-ML")
#: Logarithms of smoothing parameters stay within this of zero.
RANGE = 18.0
_ALMOST = 1e-12


@dataclass
class Sums:
    """Sums over all rows at given coefficients."""

    gram: np.ndarray  # X'WX
    right: np.ndarray  # X'Wz
    square: float  # z'Wz
    deviance: float
    rows: int
    beyond: int  # rows whose mean isn't below 1


@dataclass
class Additive:
    """A fitted model: an intercept, then each basis' columns."""

    link: str
    terms: list[bases.Basis]
    beta: np.ndarray
    parameters: dict[str, list[float]]
    covariance: np.ndarray
    influence: np.ndarray  # (X'WX + S)^-1 X'WX
    plain: np.ndarray  # X'X
    deviance: float
    rows: int
    passes: int
    columns: dict[str, slice] = field(default_factory=dict)

    def freedom(self, name: str) -> float:
        """Effective degrees of freedom of a term."""
        return float(np.diag(self.influence)[self.columns[name]].sum())

    def wald(self, name: str) -> tuple[float, float, float]:
        """(statistic, reference degrees of freedom, p-value) of a term being zero.

        The term's values over the training rows, in the metric of the inverse of their posterior covariance, cut to
        its leading eigenvectors: as many as the reference degrees of freedom, rounded.
        """
        at = self.columns[name]
        f = self.influence
        reference = float((2 * np.diag(f) - np.einsum("ij,ji->i", f, f))[at].sum())
        # a root of the term's sums of products stands for its values
        values, vectors = np.linalg.eigh(self.plain[at, at])
        root = (vectors * np.sqrt(np.maximum(values, 0))).T
        spread, axes = np.linalg.eigh(root @ self.covariance[at, at] @ root.T)
        keep = spread > spread[-1] * 1e-10
        rank = max(1, min(int(keep.sum()), round(reference)))
        lead = axes[:, ::-1][:, :rank]
        statistic = float((((lead.T @ root @ self.beta[at]) ** 2) / spread[::-1][:rank]).sum())
        return statistic, reference, chi_squared_tail(statistic, rank)

    def eta_sql(self, offset: str | None = None) -> str:
        """The linear predictor as SQL over the predictors' columns: for each term one piecewise cubic."""
        number = lambda v: f"({float(v)!r}D)"
        parts = [number(self.beta[0]), *([offset] if offset else [])]
        for b in self.terms:
            p = b.pieces @ self.beta[self.columns[b.name]]
            x = f"CAST(`{b.name}` AS DOUBLE)"
            if b.period:
                x = f"({number(b.period[0])} + pmod({x} - {number(b.period[0])}, {number(b.period[1])}))"
            if not b.breaks.size:
                parts.append(f"{number(p[0, 0])} + {number(p[0, 1])} * ({x} - {number(b.origins[0])})")
                continue
            # constants, so that the plan's code doesn't grow with the number of pieces
            array = lambda values: f"array({', '.join(values)})"
            pieces = array(array(map(number, (o, *c))) for o, c in zip(b.origins, p))
            # the piece is searched for by halves, among breaks filled up with infinities; one above all numbers is the last
            halves = [2**k for k in range(int(b.breaks.size).bit_length() - 1, -1, -1)]
            padded = array([*map(number, b.breaks), *["double('infinity')"] * (2 * halves[0] - 1 - b.breaks.size)])
            place = f"least(aggregate({array(map(str, halves))}, 0, (i, s) -> IF(element_at({padded}, i + s) <= {x}, i + s, i)), {b.breaks.size}) + 1"
            t = f"({x} - q[0])"
            parts.append(f"transform(array(element_at({pieces}, {place})), q -> q[1] + {t} * (q[2] + {t} * (q[3] + {t} * q[4])))[0]")
        return " + ".join(f"({x})" for x in parts)

    def prediction_sql(self, offset: str | None = None) -> str:
        """A statement over __THIS__ that adds the linear predictor and the mean, columns _eta and prediction."""
        return f"SELECT *, CASE WHEN _eta IS NOT NULL THEN {LINKS[self.link].sql('_eta')} END AS prediction FROM (SELECT *, {self.eta_sql(offset)} AS _eta FROM __THIS__)"


def design(terms: list[bases.Basis], columns: np.ndarray) -> np.ndarray:
    """(rows, 1 + functions) of rows of predictors."""
    return np.column_stack([np.ones(len(columns)), *(b.values(columns[:, i]) for i, b in enumerate(terms))])


def _added(rows: DataFrame, names: list[str], size: int, run: Callable) -> np.ndarray:
    """size numbers that run gives for each batch (predictors, label, offset, counts), added up in the tasks and over them."""
    def batches(frames):
        total = np.zeros(size)
        for x in frames:
            if len(x):
                total += run(x[names].to_numpy(float), *(x[c].to_numpy(float) for c in ("label", "_offset", "_n")))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"i": at.astype(np.int32), "s": total[at]})

    found = rows.select(*names, "label", "_offset", "_n").mapInPandas(batches, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(size)
    out[found["i"].to_numpy()] = found["s"].to_numpy()
    return out


def _plain(rows: DataFrame, names: list[str], terms: list[bases.Basis]) -> tuple[np.ndarray, float]:
    """(X'X, mean of the labels)."""
    p = 1 + sum(b.size for b in terms)

    def run(x, y, _, n):
        m = design(terms, x)
        return np.concatenate([((m * n[:, None]).T @ m).ravel(), [n @ y]])

    out = _added(rows, names, p * p + 1, run)
    gram = out[:-1].reshape(p, p)
    return gram, out[-1] / max(gram[0, 0], 1)


def working(x: np.ndarray, y: np.ndarray, offset: np.ndarray, beta: np.ndarray, link: Link) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights, working response without offset, deviances, whether beyond) of rows of the design."""
    eta = x @ beta + offset
    beyond = (eta >= 0) & bool(link.bounded)
    mean = np.clip(link.mean(eta), _ALMOST, 1 - _ALMOST)
    slope = np.maximum(link.slope(eta), 1e-300)
    weight = slope * slope / (mean * (1 - mean))
    weight = np.where(np.isfinite(weight), weight, 0.0)
    z = np.where(weight > 0, eta - offset + (y - mean) / slope, 0.0)
    return weight, np.where(np.isfinite(z), z, 0.0), -2 * (y * np.log(mean) + (1 - y) * np.log1p(-mean)), beyond


def _sums(rows: DataFrame, names: list[str], terms: list[bases.Basis], beta: np.ndarray, link: str) -> Sums:
    p = beta.size

    def run(x, y, offset, n):
        m = design(terms, x)
        w, z, deviance, beyond = working(m, y, offset, beta, LINKS[link])
        w = w * n
        return np.concatenate([((m * w[:, None]).T @ m).ravel(), m.T @ (w * z), [(w * z * z).sum(), n @ deviance, n.sum(), n @ beyond]])

    out = _added(rows, names, p * p + p + 4, run)
    gram = out[: p * p].reshape(p, p)
    return Sums((gram + gram.T) / 2, out[p * p : p * p + p], out[-4], out[-3], int(out[-2]), int(out[-1]))


class Criterion:
    """A smoothing criterion of the working model as a function of the parameters' logarithms."""

    def __init__(self, method: str, penalties: list[np.ndarray], gamma: float = 1.0):
        self.method, self.penalties, self.gamma = method.removeprefix("P-"), penalties, gamma
        total = sum((s / np.trace(s) for s in penalties), np.zeros_like(penalties[0]))
        values, vectors = np.linalg.eigh(total)
        self.range = vectors[:, values > values[-1] * 1e-9]
        self.ranks = [int(np.linalg.matrix_rank(s, tol=np.linalg.norm(s, 2) * 1e-9)) for s in penalties]

    def at(self, rho: np.ndarray, sums: Sums) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient, Hessian)."""
        weighted = [math.exp(r) * s for r, s in zip(rho, self.penalties)]
        inverse = np.linalg.pinv(sums.gram + sum(weighted), hermitian=True)
        beta = inverse @ sums.right
        moved = [s @ beta for s in weighted]
        m = len(rho)
        if self.method == "GCV.Cp":
            return self._error(sums, inverse, beta, weighted, moved)
        if self.method == "ML":  # the free directions aren't integrated over
            u = self.range
            whole = u @ np.linalg.inv(u.T @ (sums.gram + sum(weighted)) @ u) @ u.T
            determinant = np.linalg.slogdet(u.T @ (sums.gram + sum(weighted)) @ u)[1]
        else:
            whole = inverse
            determinant = -np.log(np.maximum(np.linalg.eigvalsh(inverse), 1e-300)).sum()
        smoothed = [whole @ s for s in weighted]
        # penalties of one term act on spaces apart, so the logarithm of their determinant is a sum
        value = ((sums.square - sums.right @ beta) / self.gamma + determinant - sum(k * r for k, r in zip(self.ranks, rho))) / 2
        bend = np.array([beta @ x for x in moved]) / self.gamma
        trace = np.array([np.trace(x) for x in smoothed])
        hessian = np.zeros((m, m))
        for i in range(m):
            for j in range(i + 1):
                both = -2 * moved[i] @ inverse @ moved[j] / self.gamma - np.einsum("ij,ji->", smoothed[i], smoothed[j])
                hessian[i, j] = hessian[j, i] = (both + (bend[i] + trace[i] if i == j else 0)) / 2
        return float(value), (bend + trace - np.array(self.ranks)) / 2, hessian

    def _error(self, sums, inverse, beta, weighted, moved):
        """Squared error and degrees of freedom, per row; the Hessian leaves out third-order terms."""
        m, n = len(weighted), sums.rows
        fit = inverse @ sums.gram
        error = sums.square - 2 * sums.right @ beta + beta @ sums.gram @ beta
        value = (error + 2 * self.gamma * np.trace(fit)) / n
        steps = [-inverse @ x for x in moved]  # of beta
        smoothed = [inverse @ s for s in weighted]
        gradient = np.array([2 * (sums.gram @ beta - sums.right) @ steps[i] - 2 * self.gamma * np.einsum("ij,ji->", smoothed[i], fit) for i in range(m)]) / n
        hessian = np.zeros((m, m))
        for i in range(m):
            for j in range(m):
                second = (inverse @ weighted[i] @ inverse @ moved[j] + inverse @ weighted[j] @ inverse @ moved[i]) - (inverse @ moved[i] if i == j else 0)
                trace = np.einsum("ij,ji->", smoothed[i] @ smoothed[j], fit) + np.einsum("ij,ji->", smoothed[j] @ smoothed[i], fit) - (np.einsum("ij,ji->", smoothed[i], fit) if i == j else 0)
                hessian[i, j] = (2 * steps[i] @ sums.gram @ steps[j] + 2 * (sums.gram @ beta - sums.right) @ second + 2 * self.gamma * trace) / n
        return float(value), gradient, (hessian + hessian.T) / 2

    def best(self, rho: np.ndarray, sums: Sums, steps: int = 60) -> np.ndarray:
        """Newton steps from rho, each halved until the criterion falls."""
        value, gradient, hessian = self.at(rho, sums)
        for _ in range(steps):
            # parameters at an end of the range that want to go further stay there
            free = ~(((rho >= RANGE) & (gradient < 0)) | ((rho <= -RANGE) & (gradient > 0)))
            if not free.any() or np.abs(gradient[free]).max() < 1e-9 * (1 + abs(value)):
                break
            size, axes = np.linalg.eigh(hessian[np.ix_(free, free)])
            size = np.maximum(np.abs(size), max(1e-7 * np.abs(size).max(), 1e-12))  # down, whatever the curvature
            step = np.zeros_like(rho)
            step[free] = -axes @ ((axes.T @ gradient[free]) / size)
            step *= min(1.0, 4.0 / np.abs(step).max())
            for _ in range(30):
                there = np.clip(rho + step, -RANGE, RANGE)
                found = self.at(there, sums)
                if found[0] <= value:
                    break
                step /= 2
            else:
                break
            done = value - found[0] < 1e-13 * (1 + abs(value))
            rho, (value, gradient, hessian) = there, found
            if done:
                break
        return rho


def fitted(rows: DataFrame, terms: list[bases.Basis], link: str = "logit", method: str = "GCV.Cp", shrink: bool = False, gamma: float = 1.0, parameters: dict[str, list[float]] | None = None, most: int = 100, close: float = 1e-9) -> Additive:
    """The model over stored rows: the predictors (all given), label (0 or 1), _offset and, if rows stand for several, _n.

    terms: bases of the predictors as yet without constraint. parameters: smoothing parameters, held, by term.
    """
    names = [b.name for b in terms]
    count = F.col("_n") if "_n" in rows.columns else F.lit(1)
    rows = rows.select(*[F.col(n).cast("double").alias(n) for n in (*names, "label", "_offset")], count.cast("double").alias("_n"))
    raw, mean = _plain(rows, names, terms)
    n = raw[0, 0]
    if not 0 < mean < 1:
        raise ValueError("both classes are needed to fit a model")
    made, at = [], 1
    for b in terms:
        size = b.size
        if b.penalties:
            b = b.centred(raw[0, at : at + size] / n)
        made.append(b)
        at += size
    # the products of the constrained columns, from those of the raw ones
    turn, at, col = np.zeros((raw.shape[0], 1 + sum(b.size for b in made))), 1, 1
    turn[0, 0] = 1
    for b, c in zip(terms, made):
        z = np.linalg.qr((raw[0, at : at + b.size] / n).reshape(-1, 1), mode="complete")[0][:, 1:] if b.penalties else np.eye(b.size)
        turn[at : at + b.size, col : col + c.size] = z
        at, col = at + b.size, col + c.size
    plain = turn.T @ raw @ turn
    columns, col = {}, 1
    for i, b in enumerate(made):
        columns[b.name] = at = slice(col, col + b.size)
        col += b.size
        if b.penalties:
            b = b.scaled(np.trace(plain[at, at]) / n / np.trace(b.penalties[0]))
            made[i] = b.with_null_penalty() if shrink else b
    p = col
    penalties, owners = [], []
    for b in made:
        for s in b.penalties:
            whole = np.zeros((p, p))
            whole[columns[b.name], columns[b.name]] = s
            penalties.append(whole)
            owners.append(b.name)
    beta = np.zeros(p)
    beta[0] = LINKS[link].start(mean)
    rho = np.full(len(penalties), math.log(max(n, 1) * 0.1))
    if parameters is not None:
        rho = np.log([x for name in dict.fromkeys(owners) for x in parameters[name]])
    criterion = Criterion(method, penalties, gamma) if penalties and parameters is None else None
    total = lambda r: sum((math.exp(x) * s for x, s in zip(r, penalties)), np.zeros((p, p)))
    sums = _sums(rows, names, made, beta, link)
    passes, worst = 2, False
    for _ in range(most):
        before = rho
        if criterion:
            rho = criterion.best(rho, sums)
        s = total(rho)
        new = np.linalg.pinv(sums.gram + s, hermitian=True) @ sums.right
        old = sums.deviance + beta @ s @ beta
        for halvings in range(30):
            found = _sums(rows, names, made, new, link)
            passes += 1
            now = found.deviance + new @ s @ new
            if not found.beyond and now <= old + 1e-7 * (0.1 + abs(old)):
                # a shortened step that gains nothing ends at the border of what the link allows
                worst = bool(halvings) and old - now < 1e-6 * (0.1 + abs(old))
                break
            new = (new + beta) / 2
        else:
            worst = True
            found, new = sums, beta
        change = float(np.sqrt(((new - beta) @ plain @ (new - beta)) / n))
        beta, sums = new, found
        if change < close * (1 + float(np.sqrt(beta @ plain @ beta / n))) and np.abs(rho - before).max(initial=0) < 1e-4 or worst:
            break
    else:
        warnings.warn(f"the fit didn't settle in {most} steps", stacklevel=2)
    s = total(rho)
    inverse = np.linalg.pinv(sums.gram + s, hermitian=True)
    held: dict[str, list[float]] = {}
    for name, r in zip(owners, rho):
        held.setdefault(name, []).append(float(math.exp(r)))
    return Additive(link, made, beta, held, inverse, inverse @ sums.gram, plain, sums.deviance, sums.rows, passes, columns)
