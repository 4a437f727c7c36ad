"""Configuration: YAML to checked, resolved dataclasses, and back."""

from __future__ import annotations

import copy
import os
from dataclasses import dataclass, field
from typing import Any

import yaml

from ..functions import headers as H
from .catalog import SPECIES
from .additive import METHODS as GAM_METHODS
from .bases import NAMES as GAM_BASES
from .links import LINKS
from .models import resolve_type
from .products import METHODS

#: The settings that a file may leave out.
DEFAULTS: dict[str, Any] = {
    "paths": {"output": "output"},
    "columns": {"lon": "lon", "lat": "lat", "year": "year", "month": "month", "day": "day", "dataset": "dataset", "dataset_filter": ["ECOMON"]},
    "species": {"threshold": {"method": "percentile", "value": 0.9, "round": True}},
    "covariates": {"source": "mock", "grid": "finest", "derived": ["jday"], "transforms": {}, "exclude": [], "prejoin": [], "steps": [], "bathymetry": [], "climate": [], "products": []},
    "model": {"type": None, "engine": None, "trees": 100, "folds": 5, "seed": 1, "tune": False, "tune_grid": 10, "bootstrap": 2000, "importance": 3},
    "projection": {"uncertainty": False},
}
#: All settings that a section may have, but for species' own fields of a catalog.
KNOWN: dict[str, set[str]] = {
    "paths": {"output", "stations", "covariates", "static", "climate"},
    "columns": {"lon", "lat", "year", "month", "day", "dataset", "dataset_filter"},
    "species": {"name", "prefix", "stages", "active", "catalog", "threshold", "min_rows", "n", "label"},
    "covariates": {"source", "grid", "variables", "products", "derived", "transforms", "log_transform", "exclude", "prejoin", "steps", "bathymetry", "climate"},
    "model": {"type", "engine", "trees", "folds", "seed", "tune", "tune_grid", "bootstrap", "level", "importance", "link", "depth", "min_n", "rate", "mtry", "k", "bs", "method", "select_features", "adjust_deg_free", "offset", "offset_transform"},
    "projection": {"uncertainty"},
    "dates": {"training", "projection"},
    "study_area": {"xmin", "xmax", "ymin", "ymax", "resolution"},
}
UNCERTAINTY = {"kind", "members", "level", "novelty"}
#: Other names of settings, by section.
OTHER_NAMES = {"model": {"family": "link", "cv_folds": "folds"}, "uncertainty": {"method": "kind", "replicates": "members"}}
SOURCES = ("mock", "parquet")
TRANSFORMS = ("log1p", "log", "log10", "abs_log", "sqrt", "fourth_root", "boxcox", "yeojohnson")
#: Derived steps with the fields they read and the columns they make.
STEPS = {"gradient", "temporal_gradient", "lag", "integral", "speed", "eke", "vertical_gradient", "ftle", "fsle", "front_distance", "contour_distance", "isobath_distance", "shore_distance"}
PREJOIN = {"upscale", "downscale", "fill_gaps"}
STAGES = (("configuration", 0.02), ("stations", 0.1), ("covariates", 0.35), ("derived", 0.5), ("matching", 0.6), ("model", 0.85), ("projection", 1.0))


class ConfigError(ValueError):
    """A setting that can't be used."""


@dataclass
class Config:
    """Checked settings; values holds the resolved tree."""

    values: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]


def _merged(base: Any, own: Any) -> Any:
    """Settings over defaults; lists replace, they don't join."""
    if isinstance(base, dict) and isinstance(own, dict):
        return {k: _merged(base.get(k), own[k]) if k in own else copy.deepcopy(base[k]) for k in {**base, **own}}
    return copy.deepcopy(base if own is None else own)


def _renamed(section: str, values: dict[str, Any]) -> dict[str, Any]:
    """Settings under their usual names; one given under both is an error."""
    other = OTHER_NAMES.get(section, {})
    twice = [k for k in values if other.get(k) in values]
    if twice:
        raise ConfigError(f"{section}.{twice[0]} and {section}.{other[twice[0]]} are the same setting")
    return {other.get(k, k): v for k, v in values.items()}


def check_names(v: dict[str, Any]) -> None:
    """No setting that nothing reads."""
    for section, values in v.items():
        if section not in KNOWN:
            raise ConfigError(f"unknown section {section!r}; known: {', '.join(KNOWN)}")
        extra = [k for k in values if k not in KNOWN[section]] if isinstance(values, dict) else [str(values)]
        if extra:
            raise ConfigError(f"unknown setting {section}.{extra[0]}; known: {', '.join(sorted(KNOWN[section]))}")
    u = v["projection"].get("uncertainty")
    if isinstance(u, dict) and set(u) - UNCERTAINTY:
        raise ConfigError(f"unknown setting projection.uncertainty.{sorted(set(u) - UNCERTAINTY)[0]}; known: {', '.join(sorted(UNCERTAINTY))}")


def _span(values: Any, what: str, low: int, high: int) -> tuple[int, int]:
    if not isinstance(values, (list, tuple)) or len(values) != 2 or not all(isinstance(v, int) for v in values) or values[0] > values[1]:
        raise ConfigError(f"{what} must be two whole numbers in order")
    if values[0] < low or values[1] > high:
        raise ConfigError(f"{what} must be between {low} and {high}")
    return values[0], values[1]


def validate(v: dict[str, Any]) -> None:
    """All checks before any data is read; raises ConfigError."""
    check_names(v)
    species = v["species"]
    if not species.get("name"):
        raise ConfigError("species.name is missing")
    t = species["threshold"]
    if t.get("method") not in ("percentile", "absolute"):
        raise ConfigError("species.threshold.method must be percentile or absolute")
    if t["method"] == "percentile" and not 0 < t.get("value", 0) < 1:
        raise ConfigError("a percentile threshold lies between 0 and 1")
    if t["method"] == "absolute" and not t.get("value", 0) > 0:
        raise ConfigError("an absolute threshold is positive")
    model = v["model"]
    resolve_type(model.get("type"), model.get("engine"))
    if model["folds"] < 2:
        raise ConfigError("model.folds must be at least 2")
    if model.get("method") and model["method"] not in GAM_METHODS:
        raise ConfigError(f"model.method must be one of {', '.join(GAM_METHODS)}")
    if model.get("link", "logit") not in LINKS:
        raise ConfigError(f"model.link must be one of {', '.join(LINKS)}")
    if model.get("k", 10) < 4:
        raise ConfigError("model.k must be at least 4")
    if not model.get("adjust_deg_free", 1) > 0:
        raise ConfigError("model.adjust_deg_free must be positive")
    times = model.get("bootstrap")
    if times not in (None, True, False) and 1 <= times < 100:
        raise ConfigError("model.bootstrap must be 0 or at least 100")
    for window in ("training", "projection"):
        w = v.get("dates", {}).get(window)
        if not w:
            raise ConfigError(f"dates.{window} is missing")
        _span(w["years"], f"dates.{window}.years", 1800, 2200)
        _span(w["months"], f"dates.{window}.months", 1, 12)
    area = v.get("study_area", {})
    try:
        west, east, south, north = (float(area[k]) for k in ("xmin", "xmax", "ymin", "ymax"))
    except (KeyError, TypeError, ValueError):
        raise ConfigError("study_area needs xmin, xmax, ymin and ymax") from None
    if west >= east or south >= north or not (-180 <= west and east <= 180 and -90 <= south and north <= 90):
        raise ConfigError("study_area isn't a box on the globe")
    c = v["covariates"]
    if c["source"] not in SOURCES:
        raise ConfigError(f"covariates.source must be one of {', '.join(SOURCES)}")
    if c["grid"] not in ("finest", "coarsest"):
        raise ConfigError("covariates.grid must be finest or coarsest")
    products = product_specs(v)
    names = [x for p in products for x in p["variables"]]
    if not names or len(set(names)) != len(names):
        raise ConfigError("covariates.variables (or those of covariates.products) must be given, each once")
    if c["source"] == "parquet" and not all(p.get("path") for p in products):
        raise ConfigError("covariates from files need paths.covariates, or a path for each product")
    for name, key, path in (("bathymetry", "static", "layers"), ("climate", "climate", "series")):
        if c[name] and c["source"] == "parquet" and not v["paths"].get(key):
            raise ConfigError(f"covariates.{name} needs paths.{key}, a table of {path}")
    left = list(names)
    for step in c["prejoin"]:
        left = _after(step, left)
    known = set(left) | set(c["bathymetry"])
    for step in c["steps"]:
        if step.get("type") not in STEPS:
            raise ConfigError(f"unknown derived step {step.get('type')!r}")
        missing = [x for x in inputs_of(step) if x not in known]
        if missing:
            raise ConfigError(f"{step['type']} reads {', '.join(missing)}, which no variable or earlier step makes")
        made = outputs_of(step)
        if known & set(made):
            raise ConfigError(f"{step['type']} would overwrite {', '.join(sorted(known & set(made)))}")
        known |= set(made)
    for name, t_ in c["transforms"].items():
        if t_ not in TRANSFORMS:
            raise ConfigError(f"unknown transform {t_!r}")
        if name not in known | {"jday", *c["climate"]}:
            raise ConfigError(f"the transform of {name!r} has no covariate")
    offset = model.get("offset")
    if offset and offset not in known:
        raise ConfigError(f"model.offset names {offset!r}, which is no covariate")
    bs = model.get("bs")
    for b in bs.values() if isinstance(bs, dict) else [bs] if bs else []:
        if b not in GAM_BASES:
            raise ConfigError(f"model.bs must be one of {', '.join(GAM_BASES)}")
    if isinstance(bs, dict) and set(bs) - known - {"jday", *c["climate"]}:
        raise ConfigError(f"model.bs names {', '.join(sorted(set(bs) - known - {'jday', *c['climate']}))}, which is no covariate")
    u = uncertainty(v)
    if u and (u["kind"] not in ("folds", "bootstrap") or not 0 < u["level"] < 1 or u["members"] < 2):
        raise ConfigError("projection.uncertainty is of kind folds or bootstrap, with at least two members and a level between 0 and 1")
    if u and u["kind"] == "folds" and model["folds"] < 3:
        raise ConfigError("uncertainty from folds needs at least three")


def product_specs(v: dict[str, Any]) -> list[dict[str, Any]]:
    """The gridded products: covariates.products, or one of covariates.variables."""
    c = v["covariates"]
    step = v.get("study_area", {}).get("resolution", 0.25)
    if c["products"]:
        return [{"resolution": step, "rename": {}, "path": None, **p} for p in c["products"]]
    return [{"variables": list(c.get("variables") or []), "resolution": step, "rename": {}, "path": v["paths"].get("covariates")}]


def _after(step: dict[str, Any], names: list[str]) -> list[str]:
    """The covariates that are left after a prejoin step, which must fit those that there are."""
    kind = step.get("type")
    if kind not in PREJOIN:
        raise ConfigError(f"unknown prejoin step {kind!r}")
    reads = ["covariate", *(["from"] if kind == "fill_gaps" else ["to"] if isinstance(step.get("to"), str) else [])]
    for key in reads:
        if step.get(key) not in names:
            raise ConfigError(f"prejoin's {key} reads {step.get(key)!r}, which is no variable at that point")
    if kind == "fill_gaps":
        return names if step.get("keep_source") else [x for x in names if x != step["from"]]
    if not isinstance(step.get("to"), str) and not (isinstance(step.get("to"), (int, float)) and step["to"] > 0):
        raise ConfigError(f"{kind} needs to: a covariate, or a spacing in degrees")
    if step.get("method") and step["method"] not in METHODS[kind]:
        raise ConfigError(f"{kind} has the methods {', '.join(METHODS[kind])}")
    return names


def inputs_of(step: dict[str, Any]) -> list[str]:
    return [step[k] for k in ("var", "u", "v", "surface", "bottom", "depth") if step.get(k)] + list(step.get("vars", []))


def levels_of(step: dict[str, Any]) -> list[float]:
    """Levels of a contour or isobath step; an isobath's are 50, 100 and 200 metres if none are given."""
    levels = step.get("levels", [step["level"]] if "level" in step else [50, 100, 200] if step["type"] == "isobath_distance" else None)
    if not levels:
        raise ConfigError(f"{step['type']} needs levels")
    return levels


def outputs_of(step: dict[str, Any]) -> list[str]:
    kind = step["type"]
    if kind in ("contour_distance", "isobath_distance"):
        return [f"{contour_prefix(step)}_{x:g}" for x in levels_of(step)]
    suffix = step.get("suffix") or {"gradient": "_grad", "temporal_gradient": "_dt", "lag": f"_lag{step.get('n', 1)}", "integral": "_int"}.get(kind)
    if suffix:
        return [f"{x}{suffix}" for x in inputs_of(step)]
    return [step.get("name") or kind]


def contour_prefix(step: dict[str, Any]) -> str:
    return step.get("prefix") or ("isobath_dist" if step["type"] == "isobath_distance" else f"{step['var']}_dist")


def uncertainty(v: dict[str, Any]) -> dict[str, Any] | None:
    u = v["projection"].get("uncertainty")
    if not u:
        return None
    base = {"kind": "folds", "members": 100, "level": 0.9, "novelty": True}
    return base if u is True else base | u


def periods(v: dict[str, Any]) -> tuple[list[int], list[int]]:
    """Years and months of both windows, as two sets: what lies between them is not read."""
    years, months = set(), set()
    for w in ("training", "projection"):
        a, b = v["dates"][w]["years"]
        years |= set(range(a, b + 1))
        a, b = v["dates"][w]["months"]
        months |= set(range(a, b + 1))
    return sorted(years), sorted(months)


def resolve(raw: dict[str, Any], folder: str = ".") -> Config:
    """Defaults, paths against the file's folder, and all checks."""
    raw = {k: _renamed(k, x) if isinstance(x, dict) else x for k, x in (raw or {}).items() if x is not None}
    v = _merged(DEFAULTS, raw)
    if isinstance(v["projection"].get("uncertainty"), dict):
        v["projection"]["uncertainty"] = _renamed("uncertainty", v["projection"]["uncertainty"])
    logs = v["covariates"].pop("log_transform", None) or []
    twice = [x for x in logs if x in v["covariates"]["transforms"]]
    if twice:
        raise ConfigError(f"{twice[0]} has a transform and stands in log_transform, too")
    v["covariates"]["transforms"] |= {x: "abs_log" for x in logs}
    active = v["species"].get("active")
    if active:
        known = v["species"].get("catalog") or SPECIES
        if active not in known:
            raise ConfigError(f"species.active is {active!r}; known: {', '.join(known)}")
        v["species"] = _merged(_merged(v["species"], known[active]), {"name": v["species"].get("name") or f"{known[active]['prefix']}_total"})
    whole = lambda p: os.path.normpath(os.path.join(folder, p)) if isinstance(p, str) and not os.path.isabs(p) and "://" not in p else p
    v["paths"] = {k: whole(p) for k, p in v["paths"].items()}
    for product in v["covariates"]["products"]:
        product["path"] = whole(product.get("path"))
    validate(v)
    return Config(v)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as file:
        return resolve(yaml.safe_load(file), os.path.dirname(os.path.abspath(path)))


def generate(path: str, name: str, years: tuple[int, int], months: tuple[int, int], box: dict[str, float], variables: list[str], **sections: dict[str, Any]) -> Config:
    """Write the settings of a run with the usual choices, and read them back. sections: more settings, by section."""
    window = {"years": list(years), "months": list(months)}
    values = {"species": {"name": name}, "dates": {"training": window, "projection": dict(window)}, "study_area": dict(box), "covariates": {"variables": list(variables)}, "model": {"type": "rf", "trees": 500, "folds": 10}}
    save(_merged(values, sections), path)
    return load(path)


def save(config: Config | dict[str, Any], path: str) -> None:
    """Write settings, and read them back; a file that doesn't load again is removed."""
    values = config.values if isinstance(config, Config) else config
    with open(path, "w", encoding="utf-8") as file:
        file.write("# settings of a run\n")
        yaml.safe_dump(values, file, sort_keys=False)
    try:
        load(path)
    except Exception:
        os.remove(path)
        raise


def check_columns(v: dict[str, Any], header: list[str]) -> list[str]:
    """The header has all that the settings name; gives the species' columns."""
    missing = [v["columns"][k] for k in ("lon", "lat", "year", "month", "day") if v["columns"][k] not in header]
    if missing:
        raise ConfigError(f"columns are missing: {', '.join(missing)}")
    name = v["species"]["name"]
    if name in header and not v["species"].get("stages"):
        return [name]
    return H.stage_columns(header, v["species"].get("prefix", name), v["species"].get("stages"))


def progress(message: str) -> float | None:
    """Share of the run that a stage's message stands for."""
    return next((share for name, share in STAGES if name in message.lower()), None)
