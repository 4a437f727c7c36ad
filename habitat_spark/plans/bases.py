"""Bases of smooth terms: piecewise cubic functions of one predictor with a penalty on their wiggliness.

Every basis here is cubic between its origins, so its functions are kept as coefficients of the powers of x - origin
in each piece, and a fitted term is one such piecewise cubic. Beyond the outer knots a term goes on as a straight line
(a cyclic one begins anew). The penalty is the integral of the squared second derivative, exactly (cr, cs, tp, ts, cc)
or as squared second differences of neighbouring coefficients (ps). cs and ts also shrink what that penalty leaves
free, straight lines, by a tenth of its least positive eigenvalue.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

#: Names of bases that a model may ask for.
NAMES = ("tp", "ts", "cr", "cs", "cc", "ps")
#: Knots of a thin-plate basis, from which its eigenfunctions are made.
PLATE_KNOTS = 60


@dataclass(frozen=True)
class Basis:
    """Functions of x: in piece i, the powers 0 to 3 of (x - origins[i]) times pieces[i] (4, functions).

    Piece i > 0 begins at breaks[i - 1]. penalties: semidefinite matrices over the functions' coefficients.
    """

    name: str
    kind: str
    breaks: np.ndarray
    origins: np.ndarray
    pieces: np.ndarray
    penalties: list[np.ndarray] = field(default_factory=list)
    period: tuple[float, float] | None = None

    @property
    def size(self) -> int:
        return self.pieces.shape[2]

    def wrapped(self, x: np.ndarray) -> np.ndarray:
        return x if self.period is None else self.period[0] + np.mod(x - self.period[0], self.period[1])

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, functions)."""
        x = self.wrapped(np.asarray(x, float))
        at = np.searchsorted(self.breaks, x, "right")
        t = x - self.origins[at]
        p = self.pieces[at]
        return p[:, 0] + t[:, None] * (p[:, 1] + t[:, None] * (p[:, 2] + t[:, None] * p[:, 3]))

    def through(self, z: np.ndarray) -> Basis:
        """The functions combined by the columns of z."""
        return replace(self, pieces=self.pieces @ z, penalties=[z.T @ s @ z for s in self.penalties])

    def centred(self, means: np.ndarray) -> Basis:
        """The combinations that sum to zero over rows in which the functions have these means."""
        q, _ = np.linalg.qr(means.reshape(-1, 1), mode="complete")
        return self.through(q[:, 1:])

    def scaled(self, factor: float) -> Basis:
        """Penalties times a factor."""
        return replace(self, penalties=[s * factor for s in self.penalties])

    def with_null_penalty(self) -> Basis:
        """One more penalty, on what the others leave free."""
        values, vectors = np.linalg.eigh(sum(self.penalties))
        free = vectors[:, values < values[-1] * 1e-8]
        return replace(self, penalties=[*self.penalties, free @ free.T * values[-1]]) if free.shape[1] else self


def linear(name: str, mean: float, deviation: float) -> Basis:
    """One column: (x - mean) / deviation, or zero for a constant; no penalty."""
    slope = 1 / deviation if deviation > 0 else 0.0
    return Basis(name, "linear", np.zeros(0), np.array([mean]), np.array([0.0, slope, 0.0, 0.0]).reshape(1, 4, 1))


def _cubic(knots: np.ndarray, values: np.ndarray, bends: np.ndarray) -> np.ndarray:
    """Pieces between knots (pieces, 4, functions) of functions with these values and second derivatives at the knots."""
    h = np.diff(knots)[:, None]
    a, b, c, d = values[:-1], values[1:], bends[:-1], bends[1:]
    return np.stack([a, (b - a) / h - h * (2 * c + d) / 6, c / 2, (d - c) / (6 * h)], axis=1)


def _with_lines(knots: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(breaks, origins, pieces) with straight lines before and after."""
    h = knots[-1] - knots[-2]
    first, last = np.zeros_like(pieces[0]), np.zeros_like(pieces[0])
    first[:2] = pieces[0][:2]
    p = pieces[-1]
    last[0], last[1] = p[0] + h * (p[1] + h * (p[2] + h * p[3])), p[1] + h * (2 * p[2] + 3 * h * p[3])
    return knots, np.concatenate([knots[:1], knots]), np.concatenate([first[None], pieces, last[None]])


def _regression(name: str, kind: str, knots: np.ndarray) -> Basis:
    """Natural cubic spline by its values at the knots."""
    k, h = knots.size, np.diff(knots)
    bend, tie = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        bend[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        tie[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            tie[i, i - 1] = tie[i - 1, i] = h[i] / 6
    inner = np.linalg.solve(tie, bend)
    zero = np.zeros((1, k))
    return Basis(name, kind, *_with_lines(knots, _cubic(knots, np.eye(k), np.concatenate([zero, inner, zero]))), [bend.T @ inner])


def _cyclic(name: str, knots: np.ndarray) -> Basis:
    """Periodic cubic spline by its values at all knots but the last, which is the first one again."""
    k, h = knots.size - 1, np.diff(knots)
    bend, tie = np.zeros((k, k)), np.zeros((k, k))
    for i in range(k):
        before, after = h[i - 1], h[i]
        bend[i, i - 1] += 1 / before
        bend[i, i] -= 1 / before + 1 / after
        bend[i, (i + 1) % k] += 1 / after
        tie[i, i - 1] += before / 6
        tie[i, i] += (before + after) / 3
        tie[i, (i + 1) % k] += after / 6
    inner = np.linalg.solve(tie, bend)
    turn = np.concatenate([np.arange(k), [0]])
    pieces = _cubic(knots, np.eye(k)[turn], inner[turn])
    return Basis(name, "cc", knots[1:-1], knots[:-1], pieces, [bend.T @ inner], (float(knots[0]), float(knots[-1] - knots[0])))


def _penalised(name: str, low: float, high: float, k: int) -> Basis:
    """Cubic B-splines at even spacing; squared second differences of their coefficients."""
    wide = (high - low) * 0.001
    low, high = low - wide, high + wide
    spans = k - 3
    h = (high - low) / spans
    # in u = (x - start) / h of a span, its four B-splines by powers of u
    span = np.array([[1, 4, 1, 0], [-3, 0, 3, 0], [3, -6, 3, 0], [-1, 3, -3, 1]]) / 6 / np.array([1, h, h**2, h**3])[:, None]
    pieces = np.zeros((spans, 4, k))
    for i in range(spans):
        pieces[i, :, i : i + 4] = span
    second = np.diff(np.eye(k), 2, axis=0)
    return Basis(name, "ps", *_with_lines(low + h * np.arange(spans + 1), pieces), [second.T @ second])


def _plate(name: str, kind: str, knots: np.ndarray, k: int) -> Basis:
    """Thin-plate spline of low rank: the k - 2 leading eigenfunctions of the bending energy, a constant and a line."""
    middle, wide = knots.mean(), float(knots.std()) or 1.0
    u = (knots - middle) / wide
    values, vectors = np.linalg.eigh(np.abs(u[:, None] - u[None, :]) ** 3 / 12)
    lead = np.argsort(-np.abs(values), kind="stable")[:k]
    flat = np.column_stack([np.ones(u.size), u])
    q, _ = np.linalg.qr((flat.T @ vectors[:, lead]).T, mode="complete")
    weights = vectors[:, lead] @ q[:, 2:]  # of each knot; their sum and first moment are zero
    energy = q[:, 2:].T @ np.diag(values[lead]) @ q[:, 2:]
    pieces = np.zeros((u.size - 1, 4, k))
    for i in range(u.size - 1):  # sum of weight * |u - knot| ** 3 / 12, in powers of u - u[i]
        sign = np.where(np.arange(u.size) <= i, 1.0, -1.0)[:, None] * weights / 12
        d = (u[i] - u)[:, None]
        pieces[i, :, : k - 2] = (sign * d**3).sum(0), (3 * sign * d**2).sum(0), (3 * sign * d).sum(0), sign.sum(0)
        pieces[i, 0, k - 2], pieces[i, 0, k - 1], pieces[i, 1, k - 1] = 1.0, u[i], 1.0
    pieces /= (wide ** np.arange(4))[:, None]
    penalty = np.zeros((k, k))
    penalty[: k - 2, : k - 2] = energy
    return Basis(name, kind, *_with_lines(knots, pieces), [(penalty + penalty.T) / 2])


def _shrunk(b: Basis) -> Basis:
    values, vectors = np.linalg.eigh(b.penalties[0])
    low = values < values[-1] * 1e-9
    values[low] = values[~low][0] * 0.1
    return replace(b, penalties=[vectors @ np.diag(values) @ vectors.T])


def smooth(name: str, kind: str, k: int, places: np.ndarray) -> Basis:
    """A basis of k functions (less if there are too few places). places: rising quantiles of the predictor, its ends among them."""
    places = np.unique(np.asarray(places, float))
    k = min(k, places.size)
    if kind not in NAMES:
        raise ValueError(f"unknown basis {kind!r}; known: {', '.join(NAMES)}")
    if k < 4:
        raise ValueError(f"{name} has too few distinct values for a smooth")
    spread = lambda n: places[np.round(np.linspace(0, places.size - 1, n)).astype(int)]
    if kind in ("tp", "ts"):
        made = _plate(name, kind, spread(min(places.size, max(PLATE_KNOTS, k))), k)
    elif kind in ("cr", "cs"):
        made = _regression(name, kind, spread(k))
    elif kind == "cc":
        made = _cyclic(name, spread(k))
    else:
        made = _penalised(name, places[0], places[-1], k)
    return _shrunk(made) if kind in ("ts", "cs") else made
