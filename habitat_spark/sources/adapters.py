"""Stations, fields, static layers, index series and held-out scores derived from the driver's tables.

Places are whole micro-degrees, so that distances and ties are the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import Lattice

X0, Y0, CELL = -76_000_000, 35_000_000, 250_000
LATTICE = Lattice(X0, Y0, CELL, CELL, 10, 10)
COARSE = Lattice(X0 + CELL // 2, Y0 + CELL // 2, 2 * CELL, 2 * CELL, 5, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("station_id"), (F.lit(X0) + 22500 * ((F.col("o_orderkey") * 37) % 101)).alias("lon_u"), (F.lit(Y0) + 22500 * ((F.col("o_custkey") * 53) % 101)).alias("lat_u"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.dayofmonth("o_orderdate").alias("day"), F.col("o_totalprice").alias("abundance"), F.col("o_orderpriority").alias("dataset"))


def degrees(df: DataFrame) -> DataFrame:
    return df.withColumns({"lon": F.col("lon_u") / F.lit(1e6), "lat": F.col("lat_u") / F.lit(1e6)})


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, ix, iy, lon_u, lat_u, year, month, sst, chl, uo, vo): means by cell and month, summed as decimals."""
    mean = lambda c: F.sum(F.col(c).cast("decimal(18,4)")).cast("double") / F.count("*")
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 100).cast("int").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), "l_quantity", "l_discount", "l_tax")
    g = li.groupBy("cell", "year", "month").agg(mean("l_quantity").alias("sst"), mean("l_discount").alias("chl"), (mean("l_tax") - 0.04).alias("uo"), (mean("l_discount") - 0.05).alias("vo"))
    return placed(g)


def placed(g: DataFrame) -> DataFrame:
    ix, iy = (F.col("cell") % 10), F.floor(F.col("cell") / 10).cast("int")
    return g.withColumns({"ix": ix, "iy": iy, "lon_u": F.lit(X0) + CELL * ix, "lat_u": F.lit(Y0) + CELL * iy})


def gappy(g: DataFrame) -> DataFrame:
    """The field with chl missing in a fixed third of its rows."""
    return g.withColumn("chl", F.when((F.col("cell") + F.col("month")) % 3 != 0, F.col("chl")))


def coarse(g: DataFrame, column: str = "chl") -> DataFrame:
    """A second product on cells of 2 x 2: (cell, ix, iy, lon_u, lat_u, year, month, column)."""
    from ..operators.fields import upscaled

    c = upscaled(g, column, 2)
    return c.select("year", "month", F.col("cx").alias("ix"), F.col("cy").alias("iy"), (F.col("cy") * 5 + F.col("cx")).alias("cell"), (F.lit(COARSE.x0) + COARSE.dx * F.col("cx")).alias("lon_u"), (F.lit(COARSE.y0) + COARSE.dy * F.col("cy")).alias("lat_u"), column)


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, depth): the cell's largest account balance; negative ones are land and null."""
    s = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 100).cast("int").alias("cell")).agg(F.max("s_acctbal").alias("d"))
    return s.select("cell", F.when(F.col("d") >= 0, F.col("d")).alias("depth"))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, month, idx): monthly order totals, in millions."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1e6).alias("idx"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, label, score) with many ties."""
    o = table(spark, sf_dir, "orders")
    s = (F.col("o_orderkey") * 7919) % 101
    return o.select(F.col("o_orderkey").alias("station_id"), (s + (F.col("o_custkey") * 31) % 100 > 120).cast("int").alias("label"), (s.cast("double") / 100).alias("score"))
