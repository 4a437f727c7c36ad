"""Made-up stations and fields with a planted signal, for tests and trial runs."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shares of stages and data sets in made-up stations.
STAGE_SHARES = {"CI": 0.05, "CII": 0.08, "CIII": 0.12, "CIV": 0.18, "CV": 0.32, "CVI": 0.25}
DATASET_SHARES = {"ECOMON": 0.85, "ECOMON_STAGED": 0.05, "MBON": 0.05, "CPR": 0.05}


def _dataset(u: Column) -> Column:
    """A data set's name by its share of the unit interval."""
    names = list(DATASET_SHARES)
    ends = list(accumulate(DATASET_SHARES.values()))
    out = F.lit(names[-1])
    for name, end in reversed(list(zip(names[:-1], ends))):
        out = F.when(u < end, name).otherwise(out)
    return out


def stations(spark: SparkSession, years: tuple[int, int], months: tuple[int, int], box: tuple[float, float, float, float], n: int = 400, seed: int = 42) -> DataFrame:
    """n stations a year; abundance rises with latitude and with the season."""
    west, east, south, north = box
    base = spark.range((years[1] - years[0] + 1) * n, numPartitions=8)
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed * 100 + k)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = base.select(
        F.col("id").alias("station_id"), (F.lit(years[0]) + F.floor(F.col("id") / n)).cast("int").alias("year"), (F.lit(months[0]) + F.floor(u(1) * (months[1] - months[0] + 1))).cast("int").alias("month"),
        (F.floor(u(2) * 28) + 1).cast("int").alias("day"), (F.lit(west) + u(3) * (east - west)).alias("lon"), (F.lit(south) + u(4) * (north - south)).alias("lat"), _dataset(u(5)).alias("dataset"),
        (F.sqrt(-2 * F.ln(u(6) + 1e-9)) * F.cos(2 * math.pi * u(7))).alias("noise"))
    effect = (F.col("lat") - south) / (north - south)
    total = F.exp(3 * effect + 1.5 * F.sin((F.col("month") - 5) / 12 * 2 * math.pi) + 0.6 * F.col("noise")) * 100
    rows = rows.withColumn("abundance", total).drop("noise")
    return rows.withColumns({f"cfin_{s}": F.col("abundance") * share for s, share in STAGE_SHARES.items()} | {"cfin_CV_VI": F.col("abundance") * (STAGE_SHARES["CV"] + STAGE_SHARES["CVI"]), "cfin_CI_IV": F.lit(0.0), "cfin_total": F.col("abundance")})


#: Name to (level, slope with latitude, slope with season, noise).
FIELDS = {"SST": (18.0, -10.0, 6.0, 0.5), "SSS": (31.0, 2.0, 0.3, 0.2), "BOTT": (8.0, -3.0, 2.0, 0.4), "UO": (0.0, 0.1, 0.05, 0.05), "VO": (0.0, -0.1, 0.05, 0.05), "SSH": (0.0, 0.2, 0.1, 0.05), "MLD": (20.0, 10.0, -10.0, 3.0), "CHL": (1.0, 2.0, 0.8, 0.2), "NO3": (4.0, 3.0, -2.0, 0.5), "O2": (260.0, 30.0, -10.0, 5.0)}


def fields(spark: SparkSession, names: list[str], years: list[int], months: list[int], box, resolution: float = 0.25, seed: int = 42) -> DataFrame:
    """A grid of the box for every year and month, with a latitude and season signal and noise."""
    west, east, south, north = box
    nx, ny = int(round((east - west) / resolution)) + 1, int(round((north - south) / resolution)) + 1
    cells = spark.range(nx * ny).select(F.col("id").cast("int").alias("cell"), (F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    steps = cells.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]))).withColumn("month", F.explode(F.array(*[F.lit(m) for m in months])))
    out = steps.withColumns({"lon_u": F.lit(round(west * 1e6)).cast("long") + F.col("ix").cast("long") * round(resolution * 1e6), "lat_u": F.lit(round(south * 1e6)).cast("long") + F.col("iy").cast("long") * round(resolution * 1e6)})
    effect = (F.col("lat_u") / 1e6 - south) / (north - south)
    season = F.sin((F.col("month") - 5) / 12 * 2 * math.pi)
    for k, name in enumerate(names):
        level, lat, time, noise = FIELDS.get(name, (0.0, 1.0, 1.0, 0.3))
        u = lambda j: F.pmod(F.xxhash64("cell", "year", "month", F.lit(seed * 1000 + 10 * k + j)), F.lit(1 << 30)) / F.lit(float(1 << 30))  # noqa: B023, E731
        out = out.withColumn(name, level + lat * effect + time * season + noise * F.sqrt(-2 * F.ln(u(1) + 1e-9)) * F.cos(2 * math.pi * u(2)))
    return out


def static(spark: SparkSession, names: list[str], box, resolution: float = 0.125) -> DataFrame:
    """Layers on a finer grid: depth falls off from the west, where land (null) is; the others are of its shape."""
    west, east, south, north = box
    u = round(resolution * 1e6)
    nx, ny = int(round((east - west) * 1e6 / u)) + 1, int(round((north - south) * 1e6 / u)) + 1
    cells = spark.range(nx * ny).select((F.lit(round(west * 1e6)).cast("long") + (F.col("id") % nx) * u).alias("lon_u"), (F.lit(round(south * 1e6)).cast("long") + F.floor(F.col("id") / nx) * u).alias("lat_u"))
    x, y = (F.col("lon_u") / 1e6 - west) / (east - west), (F.col("lat_u") / 1e6 - south) / (north - south)
    shape = {"DEPTH": 400 * x - 20 + 30 * F.sin(6 * y), "SLOPE": 2 + F.cos(6 * y), "ASPECT": 360 * y}
    wet = shape["DEPTH"] > 0
    return cells.select("*", *[F.when(wet, shape.get(n, x + y)).alias(n) for n in names])


def climate(spark: SparkSession, names: list[str], years: list[int], months: list[int]) -> DataFrame:
    """A monthly series for each name."""
    steps = spark.range(1).select(F.explode(F.array(*[F.lit(y) for y in years])).alias("year")).select("year", F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
    return steps.select("*", *[F.round(F.sin((F.col("year") * 12 + F.col("month")) * (0.3 + 0.1 * i)), 4).alias(n) for i, n in enumerate(names)])
