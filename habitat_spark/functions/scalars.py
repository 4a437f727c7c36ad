"""Column functions. Doubles that depend on summation order are summed as decimals first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month abbreviations of raw exports.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def exact_sum(x: Column | str) -> Column:
    """Sum to 10 decimals that doesn't depend on the order of rows."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(28,10)")).cast("double")


def exact_mean(x: Column | str) -> Column:
    """Mean over the rows where x is set; null if none."""
    return F.try_divide(exact_sum(x), F.count(x))


def sign_fixed(lon: Column) -> Column:
    """Longitude of the western hemisphere."""
    return F.when(lon > 0, -lon).otherwise(lon)


def stage_sum(columns: list[str]) -> Column:
    """Row sum; a missing stage adds nothing."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])


def season(month: Column) -> Column:
    return F.when(month <= 3, 1).when(month <= 6, 2).when(month <= 9, 3).otherwise(4)


def jday(year: Column, month: Column, day: Column) -> Column:
    """Day of the year; null for a date that doesn't exist."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.dayofyear(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


#: Date formats in the order they are tried.
DATE_FORMATS = ("%d-%b-%y", "%d-%b-%Y", "%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y")
_PARTS = {"%d": r"(\d{1,2})", "%m": r"(\d{1,2})", "%b": r"([A-Z]{3})", "%Y": r"(\d{4})", "%y": r"(\d{2})"}


def dated(text: Column, form: str) -> tuple[Column, Column, Column]:
    """(year, month, day) of a whole date of one format; nulls for anything else.

    Two-digit years from 69 on are of the 1900s.
    """
    order = [form[i + 1] for i, c in enumerate(form) if c == "%"]
    regex = form
    for sign, pattern in _PARTS.items():
        regex = regex.replace(sign, pattern)
    regex = f"^{regex}$"
    t = F.upper(F.trim(text))
    part = {x: F.nullif(F.regexp_extract(t, regex, i + 1), F.lit("")) for i, x in enumerate(order)}
    whole = lambda c: c.try_cast("int")
    year = whole(part["Y"]) if "Y" in part else F.when(whole(part["y"]) >= 69, whole(part["y"]) + 1900).otherwise(whole(part["y"]) + 2000)
    month = whole(part["m"]) if "m" in part else F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part["b"]).cast("int"), F.lit(0))
    day = whole(part["d"])
    good = jday(year, month, day).isNotNull()
    return tuple(F.when(good, c) for c in (year, month, day))


def split_date(text: Column) -> tuple[Column, Column, Column]:
    """The same in the first of DATE_FORMATS that each value has."""
    found = [dated(text, f) for f in DATE_FORMATS]
    return tuple(F.coalesce(*[f[i] for f in found]) for i in range(3))


def shorthand(taxon: Column, more: int | None = None) -> Column:
    """Initial of the first word and three letters of the second, or four letters of a single word; with more, 3 + more or 6 + more of the first."""
    words = F.split(F.lower(taxon), r"[ _]+")
    first, single = (1, 4) if more is None else (3 + more, 6 + more)
    return F.when(F.size(words) > 1, F.concat(F.substring(words[0], 1, first), F.substring(words[1], 1, 3))).otherwise(F.substring(words[0], 1, single))


def transform(name: str, x: Column) -> Column:
    """A fixed covariate transform, of absolute values; a logarithm of zero is null."""
    a = F.abs(x)
    return {
        "log1p": lambda: F.log1p(a),
        "log": lambda: F.ln(F.nullif(a, F.lit(0.0))),
        "log10": lambda: F.log10(F.nullif(a, F.lit(0.0))),
        "sqrt": lambda: F.sqrt(a),
        "fourth_root": lambda: F.pow(a, F.lit(0.25)),
        "abs_log": lambda: F.ln(F.nullif(a, F.lit(0.0))),
    }[name]()


def speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def vertical_gradient(surface: Column, bottom: Column, depth: Column | None = None) -> Column:
    """Surface less bottom, a metre if the depth is given."""
    return surface - bottom if depth is None else F.try_divide(surface - bottom, depth)


def cell_index(lon: Column, lat: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """(column from the west, row from the north), counted from 1."""
    return (F.floor((lon - x0) / dx) + 1).cast("int"), (F.floor((y0 - lat) / dy) + 1).cast("int")


def rounded_threshold(x: Column) -> Column:
    """From 1500 on, the nearest thousand, halves to even."""
    return F.when(F.isnan(x) | x.isNull() | (x < 1500), x).otherwise(F.bround(x / 1000, 0) * 1000)
