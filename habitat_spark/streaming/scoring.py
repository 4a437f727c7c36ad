"""Structured Streaming: new stations matched to a static field and scored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import Lattice


def scored(stations: DataFrame, field: DataFrame, values: list[str], lattice: Lattice, probability) -> DataFrame:
    """A stream of stations with the values of their own cell and the probability; a station without a cell has nulls.

    The field is static, so the join keeps no state; probability gives a Column over the values.
    """
    ix, iy = lattice.snap(F.col("lon_u"), F.col("lat_u"))
    cells = field.select("year", "month", F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "cell", *values)
    return stations.withColumn("_ix", ix).withColumn("_iy", iy).join(cells, ["year", "month", "_ix", "_iy"], "left").drop("_ix", "_iy").withColumn("score", probability())


def monthly_counts(stations: DataFrame, time: str = "ts", delay: str = "2 days", width: str = "30 days") -> DataFrame:
    """Counts and mean abundance of windows of event time; rows later than the delay are left out."""
    return stations.withWatermark(time, delay).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg("abundance").alias("mean"))
