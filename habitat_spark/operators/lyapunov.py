"""Lyapunov exponents of the current field, by particles that are carried through tiles of it.

A step's lattice is cut into tiles. A task moves the particles that are in one tile and began in one (so never more
than a tile has cells) through that tile's currents and a halo around it; particles that leave it are sent to the next
tile, in rounds, until all are done. No task holds more than a tile and its halo, or a tile's particles.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch

KM = 111.32
#: Cells along a tile's side, and the widest halo: currents that cross more than half of it in one time step are an error.
TILE = 256
HALO = 256
_STEP = ["year", "month"]


def _moved(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, h: float, left: int, low: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """One step of fourth-order Runge-Kutta in index space; currents (cells a day) are held at the border of the lattice.

    u and v begin at cell (left, low) of a lattice of shape (ny, nx).
    """
    ny, nx = shape

    def at(x, y):
        x, y = np.clip(x, 0, nx - 1), np.clip(y, 0, ny - 1)
        i, j = np.minimum(x.astype(int), nx - 2), np.minimum(y.astype(int), ny - 2)
        a, b = x - i, y - j
        i, j = i - left, j - low
        return tuple((1 - a) * (1 - b) * f[j, i] + a * (1 - b) * f[j, i + 1] + (1 - a) * b * f[j + 1, i] + a * b * f[j + 1, i + 1] for f in (u, v))

    k = [at(x, y)]
    for c in (0.5, 0.5, 1.0):
        k.append(at(x + c * h * k[-1][0], y + c * h * k[-1][1]))
    return tuple(z + h / 6 * (k[0][n] + 2 * k[1][n] + 2 * k[2][n] + k[3][n]) for n, z in enumerate((x, y)))


def trajectories(df: DataFrame, u: str, v: str, spacing_u: int, direction: int, h: float, every: int, stops: int, tile: int = TILE) -> DataFrame:
    """(year, month, ix, iy, nx, ny, xs, ys): of each cell of each step's lattice, where a particle from it is after every, 2 * every, ... steps of h days.

    Currents are in metres a second; cells that are missing, or without a current, have none.
    """
    km = spacing_u / 1e6 * KM
    speed = lambda c, shrink: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * 86.4 / (km * shrink) * direction
    cells = df.select(*_STEP, F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), speed(u, F.cos(F.radians(F.col("lat_u") / 1e6))).alias("a"), speed(v, F.lit(1.0)).alias("b"))
    most = cells.agg(F.max(F.greatest(F.abs("a"), F.abs("b")))).first()[0] or 0.0
    reach = math.ceil(most * h) + 2  # no point that a step looks at is further off
    if 2 * reach > HALO:
        raise ValueError(f"currents cross {most * h:.0f} cells in a time step, over {HALO // 2 - 2}")
    sizes = cells.groupBy(*_STEP).agg((F.max("ix") + 1).alias("nx"), (F.max("iy") + 1).alias("ny"))
    part = lambda c, by=0: F.floor((F.col(c) + by) / tile).cast("int")
    around = lambda c: F.explode(F.sequence(part(c, -2 * reach), part(c, 2 * reach)))
    halos = scratch.stored(cells.withColumn("tx", around("ix")).withColumn("ty", around("iy")), "currents")
    lattice = sizes.filter("nx > 1 and ny > 1").withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    start = {"x": F.col("ix").cast("double"), "y": F.col("iy").cast("double"), "done": F.lit(0), "xs": F.array().cast("array<double>"), "ys": F.array().cast("array<double>")}
    rows = lattice.withColumns(start)
    names = [*_STEP, "ix", "iy", "nx", "ny", "x", "y", "done", "xs", "ys"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in names)
    keys = [*_STEP, "tx", "ty", "ox", "oy"]
    slack = reach  # particles may be so far outside of their tile and still move on

    def move(key, particles: pd.DataFrame, field: pd.DataFrame) -> pd.DataFrame:
        nx, ny = (int(particles[c].iloc[0]) for c in ("nx", "ny"))
        left, low = (max(0, int(key[i]) * tile - 2 * reach) for i in (2, 3))
        right, high = min(nx, (int(key[2]) + 1) * tile + 2 * reach + 1), min(ny, (int(key[3]) + 1) * tile + 2 * reach + 1)
        currents = np.zeros((2, high - low, right - left))
        i, j = field["ix"].to_numpy() - left, field["iy"].to_numpy() - low
        currents[0, j, i], currents[1, j, i] = field["a"], field["b"]
        x, y, done = (particles[c].to_numpy().copy() for c in ("x", "y", "done"))
        xs, ys = ([list(t) for t in particles[c]] for c in ("xs", "ys"))
        sides = [(int(key[2 + n]) * tile - slack, (int(key[2 + n]) + 1) * tile + slack) for n in (0, 1)]
        while True:
            inside = [(np.clip(z, 0, size - 1) >= a) & (np.clip(z, 0, size - 1) < b) for z, size, (a, b) in zip((x, y), (nx, ny), sides)]
            go = np.flatnonzero((done < every * stops) & inside[0] & inside[1])
            if not go.size:
                break
            x[go], y[go] = _moved(currents[0], currents[1], x[go], y[go], h, left, low, (ny, nx))
            done[go] += 1
            for k in go[done[go] % every == 0].tolist():
                xs[k].append(x[k])
                ys[k].append(y[k])
        return particles[[*_STEP, "ix", "iy", "nx", "ny"]].assign(x=x, y=y, done=done, xs=xs, ys=ys)[names]

    finished = []
    while True:
        held = lambda c, size: F.least(F.greatest(F.floor(c), F.lit(0)), F.col(size) - 1)
        placed = rows.withColumns({"tx": F.floor(held("x", "nx") / tile).cast("int"), "ty": F.floor(held("y", "ny") / tile).cast("int"), "ox": part("ix"), "oy": part("iy")})
        met = halos.join(placed.select(keys).distinct().toDF(*keys), [*_STEP, "tx", "ty"])
        went = scratch.stored(placed.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(move, schema), "particles")
        finished.append(went.filter(F.col("done") == every * stops))
        rows = went.filter(F.col("done") < every * stops)
        if rows.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, finished).drop("x", "y", "done")


def _slope(c: Column, axis: str, line: str, size: str) -> Column:
    """Centred difference along an axis, one-sided at its ends."""
    w = W.partitionBy(*_STEP, line).orderBy(axis)
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    return F.when(F.col(axis) == 0, after - c).when(F.col(axis) == F.col(size) - 1, c - before).otherwise((after - before) / 2)


def ftle(df: DataFrame, u: str, v: str, spacing_u: int, direction: int = -1, days: float = 10.0, tile: int = TILE) -> DataFrame:
    """(cell, year, month, ftle): the rate (a day) of the largest stretching over a fixed time; backward by default. NaN for a step of one line."""
    ends = trajectories(df, u, v, spacing_u, direction, days / 20, 20, 1, tile).select(*_STEP, "ix", "iy", "nx", "ny", F.col("xs")[0].alias("x"), F.col("ys")[0].alias("y"))
    x, y = F.col("x"), F.col("y")
    ends = ends.withColumns({"xx": _slope(x, "ix", "iy", "nx"), "yx": _slope(y, "ix", "iy", "nx")}).withColumns({"xy": _slope(x, "iy", "ix", "ny"), "yy": _slope(y, "iy", "ix", "ny")})
    c11, c12, c22 = (F.col(a) * F.col(b) + F.col(c) * F.col(d) for a, b, c, d in (("xx", "xx", "yx", "yx"), ("xx", "xy", "yx", "yy"), ("xy", "xy", "yy", "yy")))
    half = (c11 - c22) / 2
    top = (c11 + c22) / 2 + F.sqrt(half * half + c12 * c12)
    return _with_cells(df, ends, F.ln(F.sqrt(F.greatest(top, F.lit(1e-12)))) / days, "ftle")


def fsle(df: DataFrame, u: str, v: str, spacing_u: int, direction: int = -1, final: float = 2.0, days: float = 30.0, tile: int = TILE) -> DataFrame:
    """(cell, year, month, fsle): the rate at which neighbours reach final times their first separation; 0 if they never do."""
    ways = trajectories(df, u, v, spacing_u, direction, 0.5, 2, int(days), tile)
    for name, axis, line in (("east", "ix", "iy"), ("north", "iy", "ix")):
        w = W.partitionBy(*_STEP, line).orderBy(axis)
        ways = ways.withColumn(name, F.struct(F.lead("xs").over(w).alias("xs"), F.lead("ys").over(w).alias("ys")))
    apart = lambda n, d: F.coalesce(F.hypot(n["xs"][d] - F.col("xs")[d], n["ys"][d] - F.col("ys")[d]), F.lit(0.0))
    reached = F.filter(F.sequence(F.lit(1), F.lit(int(days))), lambda d: F.greatest(apart(F.col("east"), d - 1), apart(F.col("north"), d - 1)) >= final)
    rate = F.when(F.size(reached) > 0, F.lit(math.log(final)) / F.get(reached, F.lit(0))).otherwise(0.0)
    return _with_cells(df, ways, rate, "fsle")


def _with_cells(df: DataFrame, lattice: DataFrame, value: Column, name: str) -> DataFrame:
    values = lattice.select(*_STEP, "ix", "iy", value.alias(name))
    return df.join(values, [*_STEP, "ix", "iy"], "left").select("cell", *_STEP, F.coalesce(name, F.lit(float("nan"))).alias(name))
