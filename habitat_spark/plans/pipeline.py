"""The whole run: stations and products to labelled rows, a fitted and evaluated model, and projected months."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import fields as G
from ..operators import lyapunov as L
from ..operators import match as M
from ..operators import stations as ST
from ..operators import surfaces as U
from ..sources import mock, readers, scratch
from . import models as MD
from . import products as P
from .config import Config, ConfigError, check_columns, contour_prefix, levels_of, outputs_of, periods, product_specs, uncertainty


@dataclass
class Frames:
    """Tables that take the place of what the settings name: stations (station_id, lon_u, lat_u, year, month, day,
    abundance and, if filtered by, dataset), products, static layers (lon_u, lat_u, ...) and index series (year, month, ...)."""

    stations: DataFrame | None = None
    products: list[P.Product] | None = None
    static: DataFrame | None = None
    climate: DataFrame | None = None


@dataclass
class Prepared:
    """Labelled rows, the joined field with its derived steps, and what the model may use."""

    data: DataFrame
    field: DataFrame
    means: DataFrame
    names: list[str]
    predictors: list[str]
    threshold: float
    upsampled: list[str]
    spacing_u: int


@dataclass
class Run:
    """What a run gives: lazy frames over stored stages, and kept ones, which release() lets go."""

    config: Config
    data: DataFrame
    field: DataFrame
    means: DataFrame
    model: MD.Fitted
    held_out: DataFrame
    evaluation: DataFrame
    cutoff: float | None
    threshold: float
    upsampled: list[str]
    members: list[MD.Fitted] = field(default_factory=list)
    projection: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)
    stages: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Let go of what is kept, and remove the stored stages: no frame of the run can be read after this."""
        for df in self.kept:
            df.unpersist()
        scratch.discard(*self.stages)
        self.stages.clear()


def _gradient(df, s, u, v):
    return G.horizontal_gradient(df, v, u, v + s.get("suffix", "_grad"), s.get("components", False))


def _contours(df, s, u, v):
    return G.contour_distances(df, v or s.get("depth", "DEPTH"), levels_of(s), contour_prefix(s))


def _flow(kernel: str) -> Callable:
    def made(df, s, u, v):
        found = getattr(L, kernel)(df, s["u"], s["v"], u, s.get("direction", -1))
        return df.join(found.withColumnRenamed(kernel, s.get("name", kernel)), ["cell", "year", "month"], "left")
    return made


#: Derived steps by type: functions of (field, settings, spacing in micro-degrees, variable or None). More may be added.
STEP_FUNCTIONS: dict[str, Callable[[DataFrame, dict[str, Any], int, str | None], DataFrame]] = {
    "gradient": _gradient,
    "temporal_gradient": lambda df, s, u, v: G.temporal_gradient(df, v, v + s.get("suffix", "_dt"), s.get("per", "month")),
    "lag": lambda df, s, u, v: G.lagged(df, v, s.get("n", 1), v + s.get("suffix", f"_lag{s.get('n', 1)}")),
    "integral": lambda df, s, u, v: G.integral(df, v, v + s.get("suffix", "_int"), s.get("strict_first_step", False)),
    "speed": lambda df, s, u, v: df.withColumn(s.get("name", "speed"), S.speed(F.col(s["u"]), F.col(s["v"]))),
    "eke": lambda df, s, u, v: G.eke(df, s["u"], s["v"], s.get("name", "eke"), s.get("by")),
    "vertical_gradient": lambda df, s, u, v: df.withColumn(s.get("name", "vertical_gradient"), S.vertical_gradient(F.col(s["surface"]), F.col(s["bottom"]), F.col(s["depth"]) if s.get("depth") else None)),
    "front_distance": lambda df, s, u, v: G.front_distance(df, v, u, s.get("quantile", 0.5), s.get("name", "front_distance")),
    "contour_distance": _contours,
    "isobath_distance": _contours,
    "shore_distance": lambda df, s, u, v: G.distance_to(df, F.col(v or s.get("depth", "DEPTH")).isNull(), s.get("name", "shore_distance")),
    "ftle": _flow("ftle"),
    "fsle": _flow("fsle"),
}


def derived(df: DataFrame, steps: list[dict[str, Any]], spacing_u: int) -> DataFrame:
    """Derived steps in order; each may read what an earlier one made."""
    for s in steps:
        for v in s.get("vars", [s.get("var")]):
            df = STEP_FUNCTIONS[s["type"]](df, s, spacing_u, v)
    return df


def _stations(spark: SparkSession, v: dict[str, Any], box, frames: Frames) -> DataFrame:
    if frames.stations is not None:
        s = frames.stations
        return s.withColumns({"lon": F.col("lon_u") / F.lit(1e6), "lat": F.col("lat_u") / F.lit(1e6)}).drop("lon_u", "lat_u")
    path = v["paths"].get("stations")
    if not path:
        window = v["dates"]["training"]
        return mock.stations(spark, tuple(window["years"]), tuple(window["months"]), box, v["species"].get("n", 400))
    header = readers.header_of(spark, path)
    columns = {k: v["columns"][k] for k in ("lon", "lat", "year", "month", "day", "dataset") if v["columns"].get(k) in header}
    return readers.read_stations(spark, path, columns, check_columns(v, header)).withColumn("station_id", F.xxhash64(*columns))


def _products(spark: SparkSession, v: dict[str, Any], box, frames: Frames) -> list[P.Product]:
    if frames.products is not None:
        return frames.products
    years, months = periods(v)
    out = []
    for spec in product_specs(v):
        u = round(float(spec["resolution"]) * 1e6)
        if v["covariates"]["source"] == "parquet":
            df = readers.read_field(spark, spec["path"], years, months, spec["rename"])
            out.append(P.on_lattice(df, spec["variables"]))
        else:
            nx, ny = (int(round((b - a) * 1e6 / u)) + 1 for a, b in (box[:2], box[2:]))
            out.append(P.on_lattice(mock.fields(spark, spec["variables"], years, months, box, spec["resolution"]), spec["variables"], M.Lattice(round(box[0] * 1e6), round(box[2] * 1e6), u, u, nx, ny)))
    return out


def _static(spark: SparkSession, v: dict[str, Any], box, frames: Frames) -> P.Product | None:
    """Static layers on their own lattice; a step column of ones takes the place of year and month."""
    names = v["covariates"]["bathymetry"]
    if not names:
        return None
    path = v["paths"].get("static")
    if frames.static is not None:
        df = frames.static
    elif path:
        df = spark.read.parquet(path)
    else:
        df = mock.static(spark, names, box)
    return P.on_lattice(df.withColumns({"year": F.lit(1), "month": F.lit(1)}), names)


def _with_static(cells: DataFrame, static: P.Product) -> DataFrame:
    """cells with the layers at the nearest place."""
    places = cells.select("lon_u", "lat_u").distinct().withColumns({"year": F.lit(1), "month": F.lit(1), "cell": F.xxhash64("lon_u", "lat_u")})
    return cells.join(P.at_nearest(places, static).select("lon_u", "lat_u", *static.names), ["lon_u", "lat_u"], "left")


def _climate(spark: SparkSession, v: dict[str, Any], frames: Frames) -> DataFrame | None:
    names = v["covariates"]["climate"]
    if not names:
        return None
    path = v["paths"].get("climate")
    df = frames.climate if frames.climate is not None else spark.read.parquet(path) if path else mock.climate(spark, names, *periods(v))
    return df.select("year", "month", *names)


def prepare(spark: SparkSession, config: Config, frames: Frames | None = None) -> Prepared:
    """Everything before the model: products joined, steps derived, stations matched and labelled."""
    frames = frames or Frames()
    v = config.values
    c = v["covariates"]
    box = tuple(float(v["study_area"][k]) for k in ("xmin", "xmax", "ymin", "ymax"))
    window = v["dates"]["training"]
    raw = _stations(spark, v, box, frames)
    rows = ST.stations(raw, window["years"], window["months"], box[:2], box[2:], v["columns"]["dataset_filter"] if "dataset" in raw.columns else None)
    # each nearest-cell match reads its sides more than once, so plans of several would grow without these cuts
    keep = scratch.stored
    sources = [replace(p, df=keep(p.df)) for p in _products(spark, v, box, frames)]
    product, upsampled = P.joined(P.prepared(sources, c["prejoin"], keep), c["grid"], keep)
    grid = product.df
    static = _static(spark, v, box, frames)
    static = replace(static, df=keep(static.df)) if static else None
    made = [x for s in c["steps"] for x in outputs_of(s)]
    if c["steps"]:
        from_coarse = sorted(set(upsampled) & {x for s in c["steps"] for x in (s.get("var"), *s.get("vars", ()))})
        if from_coarse:
            warnings.warn(f"steps read {', '.join(from_coarse)}, which come from a coarser grid", stacklevel=2)
        # static layers are lent to the field for the steps, and taken back
        borrowed = _with_static(grid, static) if static else grid
        if not static and any(s["type"] in ("isobath_distance", "shore_distance") and (s.get("var") or s.get("depth", "DEPTH")) not in product.names for s in c["steps"]):
            raise ConfigError("isobath and shore distances need a depth layer in covariates.bathymetry")
        grid = derived(borrowed, c["steps"], product.spacing_u)
        made = [x for x in grid.columns if x not in product.df.columns and not (static and x in static.names)]
        grid = grid.select(*product.df.columns, *made)
    numeric = {n for n, kind in grid.dtypes if kind in ("int", "bigint", "float", "double", "smallint", "tinyint") or kind.startswith("decimal")}
    names = [x for x in (*product.names, *made) if x in numeric and x not in c["exclude"]]
    grid = keep(grid.withColumn("jday", S.jday(F.col("year"), F.col("month"), F.lit(15))))
    climate = _climate(spark, v, frames)
    layers = [x for x in (static.names if static else ()) if x not in c["exclude"]]
    series = [x for x in c["climate"] if x not in c["exclude"]]
    points = rows.select("station_id", F.round(F.col("lon") * 1e6).cast("long").alias("lon_u"), F.round(F.col("lat") * 1e6).cast("long").alias("lat_u"), "year", "month", "day", "abundance", "jday")
    matched = keep(ST.complete(M.nearest(keep(points), ["station_id"], grid, names, product.lattice), names))
    if climate is not None:
        matched, grid = M.index_join(matched, climate), M.index_join(grid, climate)
    if static:
        matched, grid = keep(ST.complete(_with_static(matched, static), layers)), _with_static(grid, static)
    t = v["species"]["threshold"]
    cut = ST.threshold(matched.select("abundance"), t["value"] if t["method"] == "percentile" else None, t["value"] if t["method"] == "absolute" else None, t.get("round", True))
    data = ST.labelled(matched, cut, v["species"].get("min_rows", 100)).withColumn("label", (F.col("patch") == "patch").cast("int"))
    predictors = [*names, *(["jday"] if "jday" in c["derived"] and "jday" not in c["exclude"] else []), *series, *layers]
    return Prepared(data, grid, G.monthly_means(grid, names), names, predictors, cut, upsampled, product.spacing_u)


def _spec(m: dict[str, Any]) -> MD.Spec:
    return MD.Spec(
        type=MD.resolve_type(m.get("type"), m.get("engine")), trees=m["trees"], seed=m["seed"], link=m.get("link", "logit"), depth=m.get("depth", 5), min_n=m.get("min_n", 2), rate=m.get("rate", 0.05),
        mtry=m.get("mtry"), basis=m.get("k", 10), bs=m.get("bs"), method=m.get("method") or "GCV.Cp", shrink=bool(m.get("select_features")), gamma=float(m.get("adjust_deg_free", 1)),
        offset=m.get("offset"), offset_transform=m.get("offset_transform", "none"))


def _tried(what: str, make: Callable[[], DataFrame]) -> DataFrame | None:
    """A diagnostic's table, stored; one that fails is worth a warning, and the run goes on without it."""
    try:
        return scratch.stored(make(), what)
    except Exception as error:  # noqa: BLE001
        warnings.warn(f"no {what}: {error}", stacklevel=3)
        return None


def run(spark: SparkSession, config: Config, project: bool = True, frames: Frames | None = None) -> Run:
    """Every stage of a configured run."""
    with scratch.collected() as stages:
        out = _run(spark, config, project, frames)
        out.stages = stages
        return out


def _run(spark: SparkSession, config: Config, project: bool, frames: Frames | None) -> Run:
    v = config.values
    c, m = v["covariates"], v["model"]
    ready = prepare(spark, config, frames)
    data, grid = scratch.stored(ready.data), scratch.stored(ready.field)
    predictors, transforms = ready.predictors, c["transforms"] or None
    spec = _spec(m)
    if m["tune"]:
        spec = MD.tuned(data, predictors, MD.settings_of(spec, int(m["tune_grid"]), len(predictors)), 3, transforms)
    held, members = MD.cross_validated(data, predictors, spec, m["folds"], transforms)
    held = held.persist()
    model = MD.fit(data, predictors, spec, transforms)
    best = E.best_cutoff(held).first()
    cutoff = best["cutoff"] if best else None
    evaluation = E.evaluation_table(held)
    out = Run(config, data, grid, ready.means, model, held, evaluation, cutoff, ready.threshold, ready.upsampled, kept=[held])
    times = m["bootstrap"]
    diagnostics: dict[str, Callable[[], DataFrame]] = {"partial_effects": lambda: MD.partial_effects(model, data)}
    if times and cutoff is not None:
        diagnostics["bootstrap"] = lambda: MD.bootstrap(held, cutoff, 2000 if times is True else int(times), m.get("level", 0.95), m["seed"])
    if m["importance"]:
        diagnostics["importance"] = lambda: MD.importance(model, data, int(m["importance"]))
    if spec.type == "glm":
        diagnostics["coefficients"] = lambda: MD.coefficients(model)
    if spec.type == "gam":
        diagnostics["smooth_terms"] = lambda: MD.smooth_terms(model)
    for name, make in diagnostics.items():
        found = _tried(name, make)
        if found is not None:
            out.tables[name] = found
    if "bootstrap" in out.tables:
        out.evaluation = E.with_bounds(evaluation, out.tables["bootstrap"])
    u = uncertainty(v)
    if u:
        out.members = members if u["kind"] == "folds" else MD.ensemble(data, predictors, spec, u["members"], transforms)
    if project:
        w = v["dates"]["projection"]
        cells = ST.in_window(grid, tuple(w["years"]), tuple(w["months"]))
        out.projection = MD.projected(model, cells, out.members, data if u and u["novelty"] else None, level=u["level"] if u else 0.9)
        out.tables["coverage"] = U.coverage(cells, predictors)
    return out


def write(result: Run, folder: str) -> None:
    """Model, tables and projected months under a folder."""
    result.model.pipeline.write().overwrite().save(os.path.join(folder, "model"))
    held = result.held_out
    tables = {
        "evaluation": result.evaluation, "cv_metrics": E.fold_metrics(held), "cv_predictions": held, "monthly_means": result.means, "annual_means": G.annual_means(result.means), "roc_curve": E.roc_curve(held), "roc_curve_by_fold": E.roc_curve(held, ("fold",)), "pr_curve": E.pr_curve(held),
        "calibration": E.calibration(held), "threshold_curve": E.threshold_curve(held), "class_counts": ST.class_counts(result.data), "histogram": ST.histogram(result.data), **result.tables}
    for name, df in tables.items():
        readers.write_csv(df, os.path.join(folder, name))
    if result.projection is not None:
        readers.write_surface(result.projection, os.path.join(folder, "suitability"))
        if "novelty" in result.projection.columns:
            readers.write_csv(U.novelty_summary(result.projection), os.path.join(folder, "novelty_summary"))
    bounds = result.tables["bootstrap"].filter("series = 'cutoff'").first() if "bootstrap" in result.tables else None
    values = {"threshold": result.threshold, "cutoff": result.cutoff, "upsampled": result.upsampled, "predictors": result.model.predictors}
    if bounds:
        values |= {"cutoff_lower": bounds["lower"], "cutoff_upper": bounds["upper"]}
    scratch.write_text(held.sparkSession, os.path.join(folder, "threshold.yaml"), yaml.safe_dump(values))


def export(spark: SparkSession, folder: str, target: str) -> None:
    """Of a finished run: suitability as one CSV table of all months, and as a stack with a column for each month."""
    df = spark.read.parquet(os.path.join(folder, "suitability"))
    readers.write_csv(df.orderBy("year", "month", "cell"), os.path.join(target, "suitability_csv"))
    layers = [f"{r['year']:04d}_{r['month']:02d}" for r in df.select("year", "month").distinct().orderBy("year", "month").collect()]  # a row for each month
    df.select("cell", "lon_u", "lat_u", "year", "month", "suitability").transform(lambda d: U.stack(d, "suitability", ["cell", "lon_u", "lat_u"], layers)).write.mode("overwrite").parquet(os.path.join(target, "stack"))
