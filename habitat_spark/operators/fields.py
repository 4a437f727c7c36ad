"""Derived fields on gridded data: row-relative, neighbourhood, regridding and summary operators.

A field has cell, ix, iy, lon_u, lat_u, year, month and value columns; steps are the (year, month) pairs it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

KM_PER_DEGREE = 111.32


def _series() -> W:
    return W.partitionBy("cell").orderBy("year", "month")


def lagged(df: DataFrame, column: str, n: int = 1, name: str | None = None) -> DataFrame:
    """The value n steps before, at the same place; null in the first n steps."""
    return df.withColumn(name or f"{column}_lag{n}", F.lag(column, n).over(_series()))


def temporal_gradient(df: DataFrame, column: str, name: str | None = None, per: str = "month") -> DataFrame:
    """Change since the previous step, a month, a day (from the first of one month to that of the other) or a step."""
    w = _series()
    months = F.col("year") * 12 + F.col("month")
    first = F.make_date("year", "month", F.lit(1))
    elapsed = {"month": months - F.lag(months, 1).over(w), "day": F.datediff(first, F.lag(first, 1).over(w)), "step": F.lit(1)}[per]
    return df.withColumn(name or f"{column}_dt", (F.col(column) - F.lag(column, 1).over(w)) / elapsed)


def integral(df: DataFrame, column: str, name: str | None = None, strict_first_step: bool = False) -> DataFrame:
    """Running sum that starts anew each year; nulls add nothing. strict_first_step: none in a cell's first step."""
    w = W.partitionBy("cell", "year").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col(column).cast("decimal(28,10)")).over(w).cast("double")
    if strict_first_step:
        total = F.when(F.row_number().over(_series()) > 1, total)
    return df.withColumn(name or f"{column}_int", total)


def integral_strict(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Running sum within the year that is null from the first null on."""
    w = W.partitionBy("cell", "year").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    gaps = F.sum(F.col(column).isNull().cast("int")).over(w)
    return df.withColumn(name or f"{column}_int", F.when(gaps == 0, F.sum(F.col(column).cast("decimal(28,10)")).over(w).cast("double")))


def eke(df: DataFrame, u: str, v: str, name: str = "eke", by: list[str] | None = None) -> DataFrame:
    """Half the squared departure of currents from their mean over time (or over the groups by)."""
    keys = by or ["cell"]
    means = df.groupBy(*keys).agg(S.exact_mean(u).alias("_u"), S.exact_mean(v).alias("_v"))
    du, dv = F.col(u) - F.col("_u"), F.col(v) - F.col("_v")
    return df.join(means, keys).withColumn(name, 0.5 * (du * du + dv * dv)).drop("_u", "_v")


def with_neighbours(df: DataFrame, column: str) -> DataFrame:
    """west, east, south and north values of the same step. A row or column window holds a single grid line."""
    out = df
    for axis, line, low, high in (("ix", "iy", "west", "east"), ("iy", "ix", "south", "north")):
        w = W.partitionBy("year", "month", line).orderBy(axis)
        near = lambda d: F.when(F.lead(axis, d).over(w) == F.col(axis) + d, F.lead(column, d).over(w))  # noqa: B023, E731
        out = out.withColumns({low: near(-1), high: near(1)})
    return out


def horizontal_gradient(df: DataFrame, column: str, spacing_u: int, name: str | None = None, components: bool = False) -> DataFrame:
    """Magnitude a kilometre by centred differences; null where a neighbour is missing."""
    name = name or f"{column}_grad"
    step = 2 * spacing_u / 1e6 * KM_PER_DEGREE
    x = (F.col("east") - F.col("west")) / (step * F.cos(F.radians(F.col("lat_u") / 1e6)))
    y = (F.col("north") - F.col("south")) / F.lit(step)
    out = with_neighbours(df, column).withColumn("_x", x).withColumn("_y", y).withColumn(name, F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    if components:
        out = out.withColumnsRenamed({"_x": f"{name}_x", "_y": f"{name}_y"})
    return out.drop("_x", "_y", "west", "east", "south", "north")


#: Grid lines that one task looks at together.
LINES = 32


def envelope(x: np.ndarray, height: np.ndarray, at: np.ndarray, squeeze: float) -> np.ndarray:
    """The least of squeeze * (at - x) ** 2 + height over all x, for each at; x rising, squeeze positive.

    The lower envelope of parabolas, built from left to right in linear time: one that is nowhere least is dropped as
    soon as the next one covers it.
    """
    top: list[int] = []
    starts: list[float] = []  # from where on each is least
    xs, hs = x.tolist(), height.tolist()
    for i in range(len(xs)):
        start = -math.inf
        while top:
            j = top[-1]
            start = (xs[i] + xs[j]) / 2 + (hs[i] - hs[j]) / (2 * squeeze * (xs[i] - xs[j]))
            if start > starts[-1]:
                break
            top.pop()
            starts.pop()
            start = -math.inf
        top.append(i)
        starts.append(start)
    kept = np.array(top)
    place = np.searchsorted(np.array(starts), at, "right") - 1
    best = np.full(at.size, np.inf)
    for k in (-1, 0, 1):  # rounding may put a border a little off
        j = kept[np.clip(place + k, 0, kept.size - 1)]
        best = np.minimum(best, squeeze * (at - x[j]) ** 2 + height[j])
    return best


def _line_distances(lines: pa.Table) -> pa.Table:
    """Squared distances of the cells of some grid lines of a step: cells have a number, masked columns a height."""
    y, x, lat, d2 = (lines.column(c).to_numpy().astype(float) for c in ("iy", "lon_u", "lat_u", "_dy2"))
    cell = lines.column("cell").is_valid().to_numpy()
    out = np.full(x.size, np.nan)
    order = np.lexsort((x, y))
    for line in np.split(order, np.flatnonzero(np.diff(y[order])) + 1):
        cells, columns = line[cell[line]], line[~cell[line]]
        if cells.size and columns.size:
            # the distance is taken in degrees of longitude and latitude, the former shrunk by the line's latitude
            squeeze = max(math.cos(math.radians(lat[cells[0]] / 1e6)) ** 2, 1e-300)
            out[cells] = envelope(x[columns] / 1e6, d2[columns], x[cells] / 1e6, squeeze)
    names = ["cell", "year", "month"]
    return lines.select(names).append_column("_d", pa.array(out, mask=np.isnan(out))).filter(lines.column("cell").is_valid())


def distance_to(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """Kilometres (planar, by latitude of the cell) to the nearest cell of the step where mask holds; null if none.

    The square of a distance is a sum over both axes, so it is found along grid lines: first, in each column of the
    lattice, the nearest masked cell above and below each row (a window over one grid line); then, in each row, the
    least sum over the columns, by the lower envelope of their parabolas, in time linear in the line. A task looks at
    LINES rows of a step at a time. Cells of a column share their lon_u, those of a row their lat_u.
    """
    step = ["year", "month"]
    kinds = {c: df.schema[c].dataType for c in ("cell", "iy", "lon_u", "lat_u")}
    masked = df.filter(mask).select(*step, "ix", "iy", F.col("lat_u").alias("_at"))
    columns = df.filter(mask).groupBy(*step, "ix").agg(F.first("lon_u").alias("_lon"))
    rows = df.groupBy(*step, "iy").agg(F.first("lat_u").alias("_lat"))
    every = rows.join(columns, step).join(masked, [*step, "ix", "iy"], "left")  # the lattice of each step, for masked columns
    line = W.partitionBy(*step, "ix").orderBy("iy")
    up = F.last("_at", True).over(line.rowsBetween(W.unboundedPreceding, 0))
    down = F.first("_at", True).over(line.rowsBetween(0, W.unboundedFollowing))
    off = lambda at: ((F.col("_lat") - at) / 1e6) * ((F.col("_lat") - at) / 1e6)
    near = every.select(F.lit(None).cast(kinds["cell"]).alias("cell"), *step, "iy", F.col("_lon").alias("lon_u"), F.col("_lat").alias("lat_u"), F.least(off(up), off(down)).alias("_dy2"))
    cells = df.select("cell", *step, "iy", "lon_u", "lat_u", F.lit(None).cast("double").alias("_dy2"))
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("cell", *step)) + ", _d double"
    found = cells.unionByName(near).groupBy(*step, F.floor(F.col("iy") / LINES)).applyInArrow(_line_distances, schema)
    return df.join(found, ["cell", *step], "left").withColumn(name, F.sqrt("_d") * KM_PER_DEGREE).drop("_d")


def step_percentiles(df: DataFrame, column: str, share: float, keys: tuple[str, ...] = ("year", "month"), slots: int = 64) -> DataFrame:
    """(keys, percentile): the interpolated percentile of each group's values, all groups at once and exactly.

    Distinct values with their numbers are cut into slots at approximate quantiles of their group; running counts
    inside slots, from the counts of the slots before, tell where the two wanted places are. No group is in one task.
    A group without values has no row.
    """
    v = F.col(column).cast("double")
    runs = df.filter(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_c"))
    cuts = runs.groupBy(*keys).agg(F.percentile_approx("_v", [i / slots for i in range(1, slots)], 10_000).alias("_cuts"))
    rows = runs.join(cuts, list(keys)).withColumn("_slot", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    before = W.partitionBy(*keys).orderBy("_slot")
    sums = rows.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_s"))  # slots rows at most, for each group
    sums = sums.select(*keys, "_slot", (F.sum("_s").over(before) - F.col("_s")).alias("_o"), F.sum("_s").over(W.partitionBy(*keys)).alias("_n"))
    inside = W.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    run = rows.join(sums, [*keys, "_slot"]).withColumn("_end", F.sum("_c").over(inside) + F.col("_o"))
    at = F.lit(float(share)) * (F.col("_n") - 1)
    low = F.floor(at)
    holds = lambda place: (F.col("_end") > place) & (F.col("_end") - F.col("_c") <= place)
    first, last = F.max(F.when(holds(low), F.col("_v"))), F.max(F.when(holds(F.least(low + 1, F.col("_n") - 1)), F.col("_v")))
    part = F.max(at - low)
    return run.groupBy(*keys).agg(F.when(first == last, first).otherwise((1 - part) * first + part * last).alias("percentile"))


def front_distance(df: DataFrame, column: str, spacing_u: int, quantile: float = 0.5, name: str = "front_dist") -> DataFrame:
    """Distance to the nearest cell whose gradient is above the step's quantile."""
    graded = horizontal_gradient(df, column, spacing_u, "_grad")
    cuts = step_percentiles(graded, "_grad", quantile).withColumnRenamed("percentile", "_cut")
    return distance_to(graded.join(cuts, ["year", "month"], "left"), F.col("_grad") > F.col("_cut"), name).drop("_grad", "_cut")


def contour_distance(df: DataFrame, column: str, level: float, name: str = "contour_dist") -> DataFrame:
    """Distance to the nearest cell at which the value and a neighbour's are on different sides of the level."""
    side = F.col(column) >= level
    crosses = F.lit(False)
    out = with_neighbours(df, column)
    for c in ("west", "east", "south", "north"):
        crosses = crosses | F.coalesce((F.col(c) >= level) != side, F.lit(False))
    return distance_to(out.withColumn("_cross", crosses), F.col("_cross"), name).drop("west", "east", "south", "north", "_cross")


def contour_distances(df: DataFrame, column: str, levels: list[float], prefix: str) -> DataFrame:
    """A column <prefix>_<level> for each level."""
    for level in levels:
        df = contour_distance(df, column, level, f"{prefix}_{level:g}")
    return df


def upscaled(df: DataFrame, column: str, factor: int, method: str = "mean") -> DataFrame:
    """Cells of a coarser lattice, each combining factor x factor cells of the step."""
    agg = {"mean": S.exact_mean(column), "median": F.median(column), "min": F.min(column), "max": F.max(column)}[method]
    return df.groupBy("year", "month", F.floor(F.col("ix") / factor).cast("int").alias("cx"), F.floor(F.col("iy") / factor).cast("int").alias("cy")).agg(agg.alias(column))


def downscaled_nearest(coarse: DataFrame, column: str, factor: int) -> DataFrame:
    """Each coarse value at all its fine cells."""
    every = F.sequence(F.lit(0), F.lit(factor - 1))
    out = coarse.select("year", "month", "cx", "cy", column, F.explode(every).alias("_i")).select("*", F.explode(every).alias("_j"))
    return out.select("year", "month", (F.col("cx") * factor + F.col("_i")).alias("ix"), (F.col("cy") * factor + F.col("_j")).alias("iy"), column)


def downscaled_bilinear(fine: DataFrame, coarse: DataFrame, column: str, lattice) -> DataFrame:
    """Fine cells with the value between their four coarse corners; null if a corner is missing. lattice: that of coarse (ix, iy).

    Corners come by one explode and one equi-join.
    """
    gx, gy = ((F.col(c) - lo) / F.lit(d) for c, lo, d in (("lon_u", lattice.x0, lattice.dx), ("lat_u", lattice.y0, lattice.dy)))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    asked = fine.select("cell", "year", "month", (gx - F.floor(gx)).alias("fx"), (gy - F.floor(gy)).alias("fy"), F.floor(gx).cast("int").alias("x0"), F.floor(gy).cast("int").alias("y0"), F.explode(corners).alias("c"))
    asked = asked.select("cell", "year", "month", "fx", "fy", (F.col("x0") + F.col("c.i")).alias("ix"), (F.col("y0") + F.col("c.j")).alias("iy"), "c")
    weight = F.when(F.col("c.i") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("c.j") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    got = asked.join(coarse.select("year", "month", "ix", "iy", F.col(column).alias("_v")), ["year", "month", "ix", "iy"], "left")
    needless = weight == 0  # a corner on the other side of a grid line that the cell stands on
    return got.groupBy("cell", "year", "month").agg(F.when(F.sum(F.when(needless | F.col("_v").isNotNull(), 1).otherwise(0)) == 4, F.sum(F.when(needless, 0.0).otherwise(weight * F.col("_v")))).alias(column))


#: Tiles of one level along each side of a tile of the next level.
FAN = 4


def _levels(points: DataFrame, step: list[str], levels: int, prefix: str) -> list[DataFrame]:
    """Tiles of points (x, y, and the tile's tx, ty) at each level, up to one tile over all: its place, the number of its points and their bounding box."""
    names = {c: prefix + c for c in ("tx", "ty", "n", "x0", "x1", "y0", "y1")}
    out = [points.groupBy(*step, "tx", "ty").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))]
    for _ in range(levels):
        up = [F.floor(F.col(c) / FAN).alias(c) for c in ("tx", "ty")]
        out.append(out[-1].groupBy(*step, *up).agg(F.sum("n").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")))
    return [level.withColumnsRenamed(names) for level in out]


def nearest_tiles(askers: DataFrame, points: DataFrame, step: list[str], k: int, levels: int) -> DataFrame:
    """(step, a_tx, a_ty, p_tx, p_ty): for each tile of askers, the tiles of points that may hold one of the k nearest of any of them.

    Both sides are looked at as trees of tiles, from one over all down to the smallest. At each level, a tile of askers
    keeps those tiles of points whose box is no further off than the bound within which k points lie for certain; only
    the parts of these are looked at in the next one. All in whole numbers, so no tie is lost.
    """
    mine, theirs = _levels(askers, step, levels, "a_"), _levels(points, step, levels, "p_")
    gap = lambda c: F.greatest(F.lit(0).cast("long"), F.col(f"p_{c}0") - F.col(f"a_{c}1"), F.col(f"a_{c}0") - F.col(f"p_{c}1"))
    reach = lambda c: F.greatest(F.col(f"p_{c}1") - F.col(f"a_{c}0"), F.col(f"a_{c}1") - F.col(f"p_{c}0"))
    square = lambda of: of("x") * of("x") + of("y") * of("y")
    count = lambda s, t: F.struct((s["n"] + t["n"]).alias("n"), F.coalesce(s["far"], F.when(s["n"] + t["n"] >= k, t["far"])).alias("far"))
    pairs = mine[-1].join(theirs[-1], step).withColumn("_bound", F.lit(None).cast("long"))
    for level in range(levels, -1, -1):
        if level < levels:
            over = [[F.floor(F.col(f"{side}{c}") / FAN).alias(f"_{side}{c}") for c in ("tx", "ty")] for side in ("a_", "p_")]
            pairs = pairs.withColumnsRenamed({c: f"_{c}" for c in ("a_tx", "a_ty", "p_tx", "p_ty")})
            pairs = pairs.join(mine[level].select("*", *over[0]), [*step, "_a_tx", "_a_ty"]).join(theirs[level].select("*", *over[1]), [*step, "_p_tx", "_p_ty"])
        near = pairs.withColumn("_near", square(gap)).filter(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound")))
        tile = F.struct(square(reach).alias("far"), F.col("p_n").alias("n"), F.col("_near").alias("near"), "p_tx", "p_ty")
        held = near.groupBy(*step, "a_tx", "a_ty").agg(F.array_sort(F.collect_list(tile)).alias("_t"))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("far"))
        held = held.withColumn("_bound", F.aggregate("_t", start, count)["far"])
        kept = F.filter("_t", lambda t: F.col("_bound").isNull() | (t["near"] <= F.col("_bound")))
        pairs = held.select(*step, "a_tx", "a_ty", "_bound", F.explode(kept).alias("_t")).select(*step, "a_tx", "a_ty", "_bound", "_t.p_tx", "_t.p_ty")
    return pairs.drop("_bound")


def downscaled_idw(fine: DataFrame, coarse: DataFrame, column: str, k: int = 4, reach: int = 3) -> DataFrame:
    """Fine cells with the inverse-square-distance mean of their k nearest coarse cells of the step.

    Candidates are the coarse cells in the 3 x 3 tiles around the fine one's own (by an equi-join on tiles of reach
    coarse cells a side), where all cells within a tile's width are. A fine cell that has fewer than k of them, or whose
    k-th is further off, gets its candidates by nearest_tiles. Ties: the one further west, then south. All coarse cells,
    if the step has fewer than k; no row, if it has none.
    """
    step = ["year", "month"]
    values = coarse.filter(F.col(column).isNotNull()).select(*step, F.col("lon_u").cast("long").alias("x"), F.col("lat_u").cast("long").alias("y"), F.col(column).alias("_v"))
    asked = fine.select("cell", *step, F.col("lon_u").cast("long").alias("x"), F.col("lat_u").cast("long").alias("y"))
    ends = asked.select("x", "y").unionByName(values.select("x", "y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"))
    west, south, east, north, apart = ends.join(spacing(coarse).select("spacing")).first()  # one row
    wide = max(1, round((apart or 1.0) * 1e6)) * reach
    levels, tiles = 0, 0 if west is None else max(east - west, north - south) // wide + 1
    while FAN**levels < tiles:
        levels += 1
    placed = {"tx": F.floor((F.col("x") - F.lit(west or 0)) / F.lit(wide)), "ty": F.floor((F.col("y") - F.lit(south or 0)) / F.lit(wide))}
    values, asked = values.withColumns(placed), asked.withColumns(placed)
    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), i -> transform(array(-1, 0, 1), j -> struct(i as i, j as j))))"))
    theirs = values.withColumnsRenamed({"x": "_x", "y": "_y", "tx": "p_tx", "ty": "p_ty"})
    spots = asked.withColumn("_o", around).withColumns({"p_tx": F.col("tx") + F.col("_o.i"), "p_ty": F.col("ty") + F.col("_o.j")}).drop("_o")
    d2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
    best = lambda pairs: pairs.groupBy("cell", *step).agg(F.slice(F.array_sort(F.collect_list(F.struct(d2.alias("_d"), "_x", "_y", "_v"))), 1, k).alias("_n"))
    first = best(spots.join(theirs, [*step, "p_tx", "p_ty"]))
    sure = (F.size("_n") == k) & (F.element_at("_n", -1)["_d"] <= wide * wide)
    rest = asked.join(first.filter(sure).select("cell", *step), ["cell", *step], "left_anti")
    found = nearest_tiles(rest, values, step, k, levels).withColumnsRenamed({"a_tx": "tx", "a_ty": "ty"})
    far = best(rest.join(found, [*step, "tx", "ty"]).join(theirs, [*step, "p_tx", "p_ty"]))
    near = lambda x: 1 / F.greatest(x["_d"] / 1e12, F.lit(1e-12))
    total = lambda f: F.aggregate("_n", F.lit(0.0), lambda s, x: s + f(x))
    return first.filter(sure).unionByName(far).select("cell", *step, (total(lambda x: near(x) * x["_v"]) / total(near)).alias(column))


def spacing(df: DataFrame, axes=("lon_u", "lat_u")) -> DataFrame:
    """Step of each axis (median gap of its distinct places) and the larger one, in degrees."""
    parts = []
    for axis in axes:
        places = df.select(F.col(axis).alias("v")).distinct()  # a grid line's length, not the field's
        gaps = places.withColumn("gap", F.col("v") - F.lag("v").over(W.orderBy("v")))
        parts.append(gaps.agg((F.median("gap") / 1e6).alias(f"{axis[:3]}_step")))
    return parts[0].join(parts[1]).withColumn("spacing", F.greatest(F.col(f"{axes[0][:3]}_step"), F.col(f"{axes[1][:3]}_step")))


def thinned(df: DataFrame, max_cells: int = 50_000) -> DataFrame:
    """Every k-th distinct cell (by number), in all steps, so that about max_cells stay; all rows if there are fewer."""
    cells = df.select("cell").distinct()
    n = cells.count()
    if n <= max_cells:
        return df
    k = -(-n // max_cells)
    # places of the cells within ranges of cell numbers, then offsets of the ranges: no single sorted partition
    ranged = cells.withColumn("_b", F.floor(F.col("cell") / 65536))
    offsets = ranged.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_o", F.sum("_n").over(W.orderBy("_b")) - F.col("_n"))
    kept = ranged.join(offsets, "_b").withColumn("_r", F.col("_o") + F.row_number().over(W.partitionBy("_b").orderBy("cell")) - 1).filter(F.col("_r") % k == 0)
    return df.join(kept.select("cell"), "cell", "left_semi")


def monthly_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each covariate and month from one scan: all sums in one aggregate, then turned to rows."""
    sums = df.groupBy("year", "month").agg(*[S.exact_mean(c).alias(c) for c in columns])
    return sums.unpivot(["year", "month"], columns, "covariate", "mean")


def annual_means(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("covariate", "year").agg(S.exact_mean("mean").alias("mean"))


def climatology(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each cell and calendar month over the years."""
    return df.groupBy("cell", "month").agg(*[S.exact_mean(c).alias(c) for c in columns])


def missing_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(variable, n_cells, n_missing) of a step's cells: nulls and values that aren't finite. One aggregate."""
    gone = lambda c: F.col(c).isNull() | ~(F.abs(F.col(c).cast("double")) < float("inf"))
    counts = df.agg(F.count("*").alias("n_cells"), *[F.count_if(gone(c)).alias(c) for c in names])
    return counts.unpivot(["n_cells"], names, "variable", "n_missing").select("variable", "n_cells", "n_missing")


def month_slice(df: DataFrame, year: int, month: int) -> DataFrame:
    """The step's cells at mid-month, with day of year."""
    out = df.filter((F.col("year") == year) & (F.col("month") == month)).withColumn("day", F.lit(15))
    return out.withColumn("jday", S.jday(F.col("year"), F.col("month"), F.col("day")))
