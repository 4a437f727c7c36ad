"""Gridded products of different spacing: steps on single covariates, and the join onto one grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields as G
from ..operators import match as M
from ..operators.match import Lattice

PLACE = ["cell", "ix", "iy", "lon_u", "lat_u", "year", "month"]
METHODS = {"upscale": ("mean", "median", "min", "max"), "downscale": ("nearest", "bilinear", "idw")}


class ProductError(ValueError):
    """A step or a join that the products don't allow."""


@dataclass(frozen=True)
class Product:
    """A field on a lattice and its covariates' names."""

    df: DataFrame
    names: tuple[str, ...]
    lattice: Lattice

    @property
    def spacing_u(self) -> int:
        return max(self.lattice.dx, self.lattice.dy)


def lattice_of(df: DataFrame) -> Lattice:
    """The lattice that a field's cells lie on; its spacing is the median gap of their places along each axis."""
    gaps = G.spacing(df)
    row = df.agg(F.min("lon_u").alias("w"), F.max("lon_u").alias("e"), F.min("lat_u").alias("s"), F.max("lat_u").alias("n")).join(F.broadcast(gaps)).first()
    dx, dy = (round((row[f"{a}_step"] or 1e-6) * 1e6) for a in ("lon", "lat"))
    return Lattice(row["w"], row["s"], dx, dy, (row["e"] - row["w"]) // dx + 1, (row["n"] - row["s"]) // dy + 1)


def on_lattice(df: DataFrame, names: list[str], lattice: Lattice | None = None) -> Product:
    """A product of (lon_u, lat_u, year, month) rows; cells are numbered along its lattice."""
    lattice = lattice or lattice_of(df)
    ix, iy = lattice.snap(F.col("lon_u"), F.col("lat_u"))
    cells = df.withColumns({"ix": ix, "iy": iy})
    if "cell" not in df.columns:
        cells = cells.withColumn("cell", (F.col("iy").cast("long") * lattice.nx + F.col("ix")).cast("long"))
    return Product(cells.select(*PLACE, *names), tuple(names), lattice)


def owner(products: list[Product], covariate: str, step: str) -> int:
    """Number of the first product that has the covariate."""
    for i, p in enumerate(products):
        if covariate in p.names:
            return i
    raise ProductError(f"{step} names {covariate}; the products have {', '.join(n for p in products for n in p.names)}")


def dropped(products: list[Product], i: int, covariate: str) -> list[Product]:
    p = products[i]
    names = tuple(n for n in p.names if n != covariate)
    return [*products[:i], replace(p, df=p.df.select(*PLACE, *names), names=names), *products[i + 1 :]]


def split(products: list[Product], i: int, covariate: str) -> list[Product]:
    """The covariate as the last product of its own, unless it is alone already."""
    p = products[i]
    if p.names == (covariate,):
        return products
    return [*dropped(products, i, covariate), Product(p.df.select(*PLACE, covariate), (covariate,), p.lattice)]


def finer_lattice(own: Lattice, degrees: float) -> Lattice:
    """A lattice of that spacing from the same first cell, over the same extent."""
    u = round(degrees * 1e6)
    return Lattice(own.x0, own.y0, u, u, (own.nx - 1) * own.dx // u + 1, (own.ny - 1) * own.dy // u + 1)


def cells_of(product: Product, lattice: Lattice) -> DataFrame:
    """All cells of a lattice in each step of a product."""
    steps = product.df.select("year", "month").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = steps.select("*", every(lattice.nx).alias("ix")).select("*", every(lattice.ny).alias("iy"))
    return out.withColumns({"cell": F.col("iy").cast("long") * lattice.nx + F.col("ix"), "lon_u": F.lit(lattice.x0).cast("long") + F.col("ix") * F.lit(lattice.dx).cast("long"), "lat_u": F.lit(lattice.y0).cast("long") + F.col("iy") * F.lit(lattice.dy).cast("long")})


def at_nearest(cells: DataFrame, product: Product, names: list[str] | None = None, step: tuple[str, ...] = ("year", "month")) -> DataFrame:
    """The cells (or other points with a number cell) with the values of the product's nearest cell of the step; null if it has no such step."""
    names = list(names or product.names)
    points = cells.withColumnRenamed("cell", "_cell")
    return M.nearest(points, ["_cell", *step], product.df, names, product.lattice, list(step), left=True).drop("cell", "dist2").withColumnRenamed("_cell", "cell").select(*cells.columns, *names)


def regridded(products: list[Product], i: int, step: dict[str, Any]) -> Product:
    """An upscale or downscale step on a product of one covariate."""
    p, (name,) = products[i], products[i].names
    to, kind = step["to"], step["type"]
    method = step.get("method") or METHODS[kind][0]
    other = None if isinstance(to, (int, float)) else products[owner(products, to, kind)]
    lattice = finer_lattice(p.lattice, to) if other is None else other.lattice
    if kind == "upscale":
        if lattice.dx < p.lattice.dx or lattice.dy < p.lattice.dy:
            raise ProductError(f"upscale of {name}: the grid it goes to is finer")
        middle = lambda v, lo, d: F.floor((2 * (F.col(v) - lo) + d) / F.lit(2 * d)).cast("int")
        snapped = p.df.withColumns({"ix": middle("lon_u", lattice.x0, lattice.dx), "iy": middle("lat_u", lattice.y0, lattice.dy)})
        snapped = snapped.filter(F.col("ix").between(0, lattice.nx - 1) & F.col("iy").between(0, lattice.ny - 1))
        df = G.upscaled(snapped, name, 1, method).select("year", "month", F.col("cx").alias("ix"), F.col("cy").alias("iy"), name)
        df = df.withColumns({"cell": F.col("iy").cast("long") * lattice.nx + F.col("ix"), "lon_u": F.lit(lattice.x0).cast("long") + F.col("ix") * F.lit(lattice.dx).cast("long"), "lat_u": F.lit(lattice.y0).cast("long") + F.col("iy") * F.lit(lattice.dy).cast("long")})
        return Product(df.select(*PLACE, name), (name,), lattice)
    if lattice.dx > p.lattice.dx or lattice.dy > p.lattice.dy:
        raise ProductError(f"downscale of {name}: the grid it goes to is coarser")
    cells = other.df.select(*PLACE) if other is not None else cells_of(p, lattice).select(*PLACE)
    if method == "nearest":
        df = at_nearest(cells, p)
    else:
        made = G.downscaled_bilinear(cells, p.df, name, p.lattice) if method == "bilinear" else G.downscaled_idw(cells, p.df, name, step.get("k", 4))
        df = cells.join(made, ["cell", "year", "month"], "left")
    return Product(df.select(*PLACE, name), (name,), lattice)


def prepared(products: list[Product], steps: list[dict[str, Any]], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[Product]:
    """The products after the steps, in order; a step on one covariate of several takes it out of its product first.

    keep: called on what later steps read several times, such as DataFrame.persist.
    """
    for step in steps:
        kind, name = step["type"], step["covariate"]
        products = split(products, owner(products, name, kind), name)
        i = owner(products, name, kind)
        if kind != "fill_gaps":
            made = regridded(products, i, step)
            products = [*products[:i], replace(made, df=keep(made.df)), *products[i + 1 :]]
            continue
        source = step["from"]
        j = owner(products, source, kind)
        both = at_nearest(products[i].df, products[j], [source]).withColumnRenamed(source, "_from")
        if step.get("rescale"):
            both = M.rescaled(both, "_from", name)
        filled = keep(M.filled(both, name, "_from").select(*PLACE, name, f"{name}_source"))
        products = [*products[:i], replace(products[i], df=filled, names=(name, f"{name}_source")), *products[i + 1 :]]
        if not step.get("keep_source"):
            products = dropped(products, j, source)
    return [p for p in products if p.names]


def joined(products: list[Product], grid: str = "finest", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[Product, list[str]]:
    """(all covariates on the finest or coarsest product's grid, those that come from a coarser grid than that).

    Each other product gives the values of its nearest cell of the step, so finer ones are sampled, not averaged.
    """
    order = sorted(products, key=lambda p: p.spacing_u, reverse=grid == "coarsest")
    first = order[0]
    df = first.df
    for p in order[1:]:
        df = keep(at_nearest(df, p))
    names = tuple(n for p in order for n in p.names)
    return Product(df, names, first.lattice), [n for p in order for n in p.names if p.spacing_u > first.spacing_u]
