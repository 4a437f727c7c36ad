"""Readers of station files, raw exports and gridded products, and table sinks."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import scalars as S


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names alone: one line is read, no types are guessed."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def available_stages(spark: SparkSession, path: str, prefix: str, single_only: bool = True) -> list[str]:
    """Stages of a taxon that a station file has: single ones and aliases, or all its columns' but the total."""
    return list(H.stage_pool(header_of(spark, path), prefix, single_only))


def read_stations(spark: SparkSession, path: str, columns: dict[str, str], taxon: str | list[str]) -> DataFrame:
    """(station columns, abundance) of a wide station file.

    columns: canonical name to the file's. taxon: one column, or stage columns to add up. Only these are parsed.
    """
    header = header_of(spark, path)
    wanted = [*columns.values(), *([taxon] if isinstance(taxon, str) else taxon)]
    missing = [c for c in wanted if c not in header]
    if missing:
        raise ValueError(f"columns are not in {path}: {', '.join(missing)}")
    raw = spark.read.csv(path, header=True, nullValue="NA").select(*[F.col(f"`{c}`") for c in wanted])
    kinds = {"year": "int", "month": "int", "day": "int", "lon": "double", "lat": "double"}
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").try_cast("double")), F.col(f"`{c}`").try_cast("double"))
    abundance = number(taxon) if isinstance(taxon, str) else reduce(lambda a, b: a + b, [F.coalesce(number(c), F.lit(0.0)) for c in taxon])
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[k]).alias(k) if k in kinds else F.col(f"`{c}`").alias(k) for k, c in columns.items()], abundance.alias("abundance"))


def split_dates(df: DataFrame, column: str = "DATE", formats: tuple[str, ...] = S.DATE_FORMATS, keep: bool = False) -> DataFrame:
    """df with year, month and day in place of a text column of dates, all of one format: the first that every value has.

    One aggregate counts what each format leaves unread. Years to come are worth a warning.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
    text = F.col(f"`{column}`").cast("string")
    there = F.coalesce(F.trim(text) != "", F.lit(False))
    read = [S.dated(text, f) for f in formats]
    left = [F.sum(F.when(there & y.isNull(), 1).otherwise(0)).alias(f"x{i}") for i, (y, _, _) in enumerate(read)]
    ahead = [F.sum(F.when(there & (y > F.year(F.current_date())), 1).otherwise(0)).alias(f"a{i}") for i, (y, _, _) in enumerate(read)]
    bad = F.first(F.when(there & read[0][0].isNull(), text), ignorenulls=True).alias("bad")
    row = df.agg(F.sum(there.cast("int")).alias("n"), bad, *left, *ahead).first()
    if not row["n"]:
        raise ValueError(f"every value of {column} is missing")
    best = next((i for i in range(len(formats)) if not row[f"x{i}"]), None)
    if best is None:
        raise ValueError(f"{row['x0']} of {row['n']} dates of {column} fit none of {', '.join(formats)}, such as {row['bad']!r}")
    if row[f"a{best}"]:
        warnings.warn(f"{row[f'a{best}']} dates of {column} are in years to come; two digits can't tell 1969 from 2069", stacklevel=2)
    out = df.withColumns(dict(zip(("year", "month", "day"), read[best])))
    return out if keep else out.drop(column)


def format_stations(raw: DataFrame, suffix: str | None = None) -> DataFrame:
    """A raw export as a station table: dates split, places renamed, counts a unit of area or volume, taxa renamed."""
    header = raw.columns
    if not H.is_raw_export(header):
        raise ValueError("not a raw export: it needs LATITUDE, LONGITUDE and DATE, and no canonical columns")
    suffix = suffix or H.raw_suffix(header)
    taxa = H.zoop_taxa(header, suffix) if suffix else []
    if not taxa:
        raise ValueError("no column has a count suffix")
    H.check_taxa(taxa, header)
    raw = split_dates(raw)
    counted = {t.column for t in taxa}
    lead = [F.col("STATION").alias("station")] if "STATION" in header else []
    rest = [F.col(f"`{c}`") for c in header if c not in counted and c not in ("STATION", *H.RAW_COLUMNS)]
    return raw.select(*lead, "year", "month", "day", F.col("LATITUDE").cast("double").alias("lat"), F.col("LONGITUDE").cast("double").alias("lon"), *[(F.col(f"`{t.column}`").cast("double") / t.per).alias(t.name) for t in taxa], *rest)


def read_field(spark: SparkSession, path: str, years: list[int] | None = None, months: list[int] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """A gridded product from Parquet: only the asked years and months are listed and read if it is partitioned by them."""
    df = spark.read.parquet(path).withColumnsRenamed(rename or {})
    if years:
        df = df.filter(F.col("year").isin(years))
    if months:
        df = df.filter(F.col("month").isin(months))
    return df


def write_surface(df: DataFrame, path: str) -> None:
    """Projected cells by month; one job, each month's files written where its rows are."""
    df.write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def joined_header(rows: list[list[str | None]]) -> list[str]:
    """One header of several header lines: each column's parts joined."""
    return ["_".join(p.strip() for p in parts if p and p.strip()) for parts in zip(*rows)]


def read_lines(spark: SparkSession, path: str, header_lines: list[int], first_line: int, separator: str = ",") -> DataFrame:
    """Text tables whose header stands on given lines (from 1; several are joined) and whose data begin at another; NA and -9999 are null.

    Lines are counted in each file, which is read as one record: for short forms, not for large files. All files must
    have the header of the first by name.
    """
    files = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"), F.col("_metadata.file_path").alias("file"))
    at = [F.get("lines", F.lit(n - 1)) for n in header_lines]
    head = files.orderBy("file").select(*at).first()
    names = [x.strip() for x in joined_header([str(h or "").split(separator) for h in head])]
    rows = files.select(F.explode(F.slice("lines", first_line, F.greatest(F.size("lines") - (first_line - 1), F.lit(0)))).alias("line")).filter(F.trim("line") != "")
    parts = F.split("line", separator)
    value = lambda i: F.trim(F.get(parts, F.lit(i)))
    return rows.select(*[F.when(~value(i).isin("", "NA", "-9999"), value(i)).alias(n) for i, n in enumerate(names) if n not in ("", "NA")])
