"""Filters, labels and summaries of station tables."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def in_window(df: DataFrame, years: tuple[int, int], months: tuple[int, int]) -> DataFrame:
    """Rows of a rectangle of years and months, bounds included."""
    return df.filter(F.col("year").between(*years) & F.col("month").between(*months))


def in_box(df: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """Rows in a box, all four sides included."""
    return df.filter(F.col("lon").between(*lon) & F.col("lat").between(*lat))


def stations(df: DataFrame, years, months, lon, lat, datasets: list[str] | None = None) -> DataFrame:
    """The model's input rows: placed and counted, in the window, in the box, of the data sets, with day of year."""
    out = in_box(in_window(df.dropna(subset=["lon", "lat", "abundance"]).withColumn("lon", S.sign_fixed(F.col("lon"))), years, months), lon, lat)
    if datasets is not None:
        out = out.filter(F.col("dataset").isin(datasets))
    return out.withColumn("jday", S.jday(F.col("year"), F.col("month"), F.col("day")))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null, NaN or infinite value in those of the columns that exist."""
    there = [c for c in columns if c in df.columns]
    finite = [F.abs(c) < float("inf") for c, kind in df.dtypes if c in there and kind in ("float", "double")]  # NaN is above all
    return functools.reduce(DataFrame.filter, finite, df.dropna(how="any", subset=there) if there else df)


#: Distinct values that are brought together to look up an order statistic.
FEW = 1000
#: Of approximate quantiles: they are off by this share of the rows' number, inverted, at most.
SHARP = 10_000


def percentile_of(df: DataFrame, share: float, value: str = "abundance", span=None) -> float | None:
    """The interpolated percentile of all values; null without values. span: what spans gave for the share, if known.

    Approximate quantiles a little below and above hold the wanted places between them, as their error is bounded (one
    in SHARP rows). One pass counts what lies below and gathers the few distinct values between; if these are over FEW, the same again
    among them. No step holds more than a bounded number of values.
    """
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(v.alias("v"))
    n, low, high, near = span or rows.agg(*spans("v", share)).first()
    if not n:
        return None
    if n >= 300:  # fewer rows are looked at as they are
        low, high = (near[1], near[2]) if n >= SHARP else (near[0], near[3])
    at = share * (n - 1)
    first, last = int(at), min(int(at) + 1, n - 1)
    while True:
        part = rows.filter(F.col("v") <= high).groupBy(F.when(F.col("v") >= low, F.col("v")).alias("v")).agg(F.count("*").alias("c"))
        values = [tuple(r) for r in part.orderBy("v").limit(FEW + 2).collect()]  # what lies below comes first, under null
        below = values.pop(0)[1] if values[0][0] is None else 0
        if len(values) <= FEW:
            break
        inner = rows.filter(F.col("v").between(low, high))
        size = inner.count()
        wide = 3 / SHARP if size >= SHARP else 0.01
        low, high = inner.agg(F.percentile_approx("v", [max(0.0, (first - below) / size - wide), min(1.0, (last + 1 - below) / size + wide)], SHARP)).first()[0]
    found = {}
    for x, c in values:
        found |= {place: x for place in (first, last) if below <= place < below + c}
        below += c
    return found[first] + (found[last] - found[first]) * (at - first)


def spans(value: str, share: float) -> list[Column]:
    """Columns of an aggregate: the number of values, their least and largest, and approximate quantiles around the share."""
    v = F.col(value).cast("double")
    near = [max(0.0, share - 0.01), max(0.0, share - 3 / SHARP), min(1.0, share + 3 / SHARP), min(1.0, share + 0.01)]
    return [F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.percentile_approx(v, near, SHARP).alias("near")]


def rounded(cut: float) -> float:
    """From 1500 on, the nearest thousand, halves to even."""
    return cut if cut < 1500 else round(cut / 1000) * 1000.0


def threshold(df: DataFrame, percentile: float | None = 0.9, absolute: float | None = None, round_: bool = True, value: str = "abundance") -> float:
    """The patch threshold: given, or an interpolated percentile (rounded from 1500 on)."""
    if absolute is not None:
        return float(absolute)
    span = df.agg(*spans(value, percentile)).first()
    _, low, high, *_ = span
    if high is None:
        raise ValueError("no station has an abundance")
    if high == 0:
        raise ValueError("every abundance is zero")
    if low == high:
        raise ValueError("all abundances are the same")
    cut = percentile_of(df, percentile, value, span)
    return float(rounded(cut) if round_ else cut)


def labelled(df: DataFrame, cut: float, min_rows: int = 100, check: bool = True) -> DataFrame:
    """patch or non_patch by abundance >= cut. check: enough rows and both classes, in one aggregate."""
    if check:
        n, patches = df.agg(F.count("*"), F.sum((F.col("abundance") >= cut).cast("int"))).first()
        if n < min_rows:
            raise ValueError(f"{n} stations; at least {min_rows} are needed")
        if not patches or patches == n:
            raise ValueError("only one class is left at this threshold")
    return df.withColumn("patch", F.when(F.col("abundance") >= cut, "patch").otherwise("non_patch")).withColumn("threshold", F.lit(cut))


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("patch").agg(F.count("*").alias("n"))


def summary(df: DataFrame) -> DataFrame:
    """One row: size, period, extent and spread of abundance."""
    a = F.col("abundance")
    return df.agg(
        F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("month").cast("long").alias("n_months"),
        F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.round(F.median(a), 6).alias("median"), F.round(F.percentile(a, 0.9), 6).alias("p90"), F.max(a).alias("largest"),
        F.round(100.0 * F.sum((a == 0).cast("int")) / F.count(a), 6).alias("percent_zero"))


def monthly_median(df: DataFrame) -> DataFrame:
    """Median abundance of each month, at x = year + (month - 0.5) / 12."""
    return df.groupBy("year", "month").agg(F.round(F.median("abundance"), 6).alias("median")).withColumn("x", F.round(F.col("year") + (F.col("month") - 0.5) / 12, 6))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the first by the order, found with partial aggregates instead of a sort of each key."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*")


def stage_columns(df: DataFrame, prefix: str) -> list[str]:
    """Columns of a taxon's stages, its total left out."""
    return [c for c in df.columns if c.lower().startswith(prefix.lower() + "_") and not c.lower().endswith("_total")]


def histogram(df: DataFrame, bins: int = 40, value: str = "abundance") -> DataFrame:
    """Counts in equal bins of log1p of the value, from 0 to the largest."""
    top = df.agg(F.max(F.log1p(value))).first()[0] or 1.0
    at = F.least(F.floor(F.log1p(value) / (top / bins)), F.lit(bins - 1)).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).withColumns({"low": F.expm1(F.col("bin") * (top / bins)), "high": F.expm1((F.col("bin") + 1) * (top / bins))})
