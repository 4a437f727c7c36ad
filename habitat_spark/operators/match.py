"""Joins of points to the nearest grid cell of the same step, and other joins by place and time.

Coordinates are whole micro-degrees, so distances are exact and ties are real; the lowest cell wins a tie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEP = ["year", "month"]


@dataclass(frozen=True)
class Lattice:
    """A regular grid: the first cell's place, the spacing and the number of cells, in micro-degrees."""

    x0: int
    y0: int
    dx: int
    dy: int
    nx: int
    ny: int

    def snap(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(ix, iy) of the nearest cell; half-way goes to the lower one."""
        # half-way down: ceil(x - 1/2), in whole numbers
        one = lambda v, lo, d, n: F.least(F.greatest(F.floor((2 * (v - lo) + (d - 1)) / F.lit(2 * d)), F.lit(0)), F.lit(n - 1)).cast("int")
        return one(lon, self.x0, self.dx, self.nx), one(lat, self.y0, self.dy, self.ny)


def distance2(a: str, b: str) -> Column:
    """Squared planar distance in micro-degrees."""
    dx, dy = (F.col(f"{a}{c}").cast("long") - F.col(f"{b}{c}").cast("long") for c in ("lon_u", "lat_u"))
    return dx * dx + dy * dy


def nearest_naive(points: DataFrame, key: list[str], grid: DataFrame, values: list[str], step: list[str] = STEP, left: bool = False) -> DataFrame:
    """Every cell of the step is a candidate of each point; the least (distance, cell) is kept by partial aggregates."""
    cells = grid.select(*step, F.col("cell"), F.col("lon_u").alias("g_lon_u"), F.col("lat_u").alias("g_lat_u"), *values)
    pairs = points.join(cells, step, "left" if left else "inner").withColumn("dist2", distance2("", "g_"))
    best = F.min(F.when(F.col("cell").isNotNull(), F.struct("dist2", "cell", *values))).alias("_best")
    carried = [c for c in points.columns if c not in key]
    return pairs.groupBy(*key).agg(best, *[F.first(c).alias(c) for c in carried]).select(*points.columns, "_best.*")


def nearest(points: DataFrame, key: list[str], grid: DataFrame, values: list[str], lattice: Lattice, step: list[str] = STEP, left: bool = False) -> DataFrame:
    """The same rows as nearest_naive, on a lattice: a point's own cell by an equi-join; a point whose cell is missing
    in its step looks, in each column of the lattice, at the next cell above and below its row."""
    ix, iy = lattice.snap(F.col("lon_u"), F.col("lat_u"))
    cells = grid.select(*step, F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("cell"), F.col("lon_u").alias("g_lon_u"), F.col("lat_u").alias("g_lat_u"), *values)
    own = points.withColumn("_ix", ix).withColumn("_iy", iy).join(cells, [*step, "_ix", "_iy"], "left")
    found = own.filter(F.col("cell").isNotNull()).withColumn("dist2", distance2("", "g_")).select(*points.columns, "dist2", "cell", *values)
    missing = own.filter(F.col("cell").isNull()).select(*points.columns, "_iy")
    # in a column, the nearest cell is the last one up to the point's row or the first one from it on; of two cells at
    # one distance the lower number counts, so both are kept
    columns = cells.select(*step, "_ix").distinct()
    rows = missing.select(*step, "_iy").distinct()
    spots = rows.join(columns, step).select(*step, "_ix", "_iy", F.lit(True).alias("_ask"))
    held = F.struct("cell", "g_lon_u", "g_lat_u", *values)
    both = spots.join(cells.select(*step, "_ix", "_iy", held.alias("_c")), [*step, "_ix", "_iy"], "full_outer")
    line = W.partitionBy(*step, "_ix").orderBy("_iy")
    near = F.array(F.last("_c", True).over(line.rowsBetween(W.unboundedPreceding, 0)), F.first("_c", True).over(line.rowsBetween(0, W.unboundedFollowing)))
    lines = both.withColumn("_n", near).filter("_ask").groupBy(*step, "_iy").agg(F.array_distinct(F.flatten(F.collect_list(F.filter("_n", lambda c: c.isNotNull())))).alias("_n"))  # two cells for each column
    dx, dy = (lambda c: F.col("lon_u").cast("long") - c["g_lon_u"].cast("long")), (lambda c: F.col("lat_u").cast("long") - c["g_lat_u"].cast("long"))
    best = F.array_min(F.transform("_n", lambda c: F.struct((dx(c) * dx(c) + dy(c) * dy(c)).alias("dist2"), c["cell"].alias("cell"), *[c[v].alias(v) for v in values])))
    far = missing.join(lines, [*step, "_iy"], "left" if left else "inner").withColumn("_best", best).select(*points.columns, "_best.*")
    return found.unionByName(far)


def index_join(df: DataFrame, index: DataFrame, step: list[str] = STEP) -> DataFrame:
    """A monthly series joined by time; it has one row for each month, so it is small by its nature."""
    return df.join(index, step, "left")


def filled(df: DataFrame, target: str, other: str) -> DataFrame:
    """Gaps of target from other, with where each value is from."""
    source = F.when(F.col(target).isNotNull(), "satellite").when(F.col(other).isNotNull(), "model")
    return df.withColumn(f"{target}_source", source).withColumn(target, F.coalesce(target, other))


def rescaled(df: DataFrame, other: str, target: str) -> DataFrame:
    """other with the mean and spread that target has where both are set; as it was where it is constant there."""
    both = df.filter(F.col(other).isNotNull() & F.col(target).isNotNull())
    moments = both.agg(F.avg(other).alias("_m1"), F.stddev_samp(other).alias("_s1"), F.avg(target).alias("_m2"), F.stddev_samp(target).alias("_s2"))  # one row
    moved = (F.col(other) - F.col("_m1")) / F.col("_s1") * F.col("_s2") + F.col("_m2")
    return df.join(F.broadcast(moments)).withColumn(other, F.when(F.col("_s1") > 0, moved).otherwise(F.col(other))).select(*df.columns)


def rounded_key(u: Column, to: int = 100_000) -> Column:
    """Micro-degrees rounded to a coarser unit, halves up."""
    return F.floor((u + to // 2) / F.lit(to)).cast("long")


def folded(frames: list[DataFrame], keys: list[str], how: str) -> DataFrame:
    """Frames joined one after another on the same keys; equal keys keep their partitioning from join to join."""
    return reduce(lambda a, b: a.join(b, keys, how), frames)
