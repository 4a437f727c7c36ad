"""What settings may name: covariates with their labels and units, static layers, climate indices, species."""

from __future__ import annotations

import math
from dataclasses import dataclass

from ..functions.headers import dataset_resolution

#: Product and data set of each group of gridded covariates, and the spacing and period in its name.
PHYSICS = "cmems_mod_glo_phy_my_0.083deg_P1M-m"
COLOUR = "satellite ocean colour, 4km P1M"
BIOGEOCHEMISTRY = "biogeochemistry hindcast, 0.25deg P1M"
ETOPO = "ETOPO relief, 4 arc minutes"

#: Name, label, units, data set.
_GRIDDED = (
    ("SST", "Sea surface temperature", "degrees C", PHYSICS), ("SSS", "Sea surface salinity", "PSU", PHYSICS), ("BOTT", "Bottom temperature", "degrees C", PHYSICS),
    ("UO", "Eastward current velocity", "m/s", PHYSICS), ("VO", "Northward current velocity", "m/s", PHYSICS), ("SSH", "Sea surface height", "m", PHYSICS),
    ("MLD", "Mixed layer depth", "m", PHYSICS), ("SIC", "Sea ice concentration", "fraction", PHYSICS), ("CHL", "Chlorophyll-a concentration", "mg/m3", COLOUR),
    ("PP", "Primary production", "mg/m2/day", COLOUR), ("DIATO", "Diatoms", "mg/m3", COLOUR), ("DINO", "Dinoflagellates", "mg/m3", COLOUR),
    ("NO3", "Nitrate concentration", "mmol/m3", BIOGEOCHEMISTRY), ("PO4", "Phosphate concentration", "mmol/m3", BIOGEOCHEMISTRY), ("O2", "Dissolved oxygen", "mmol/m3", BIOGEOCHEMISTRY),
    ("PH", "pH", "", BIOGEOCHEMISTRY), ("CHL_MODEL", "Chlorophyll-a concentration, modelled", "mg/m3", BIOGEOCHEMISTRY), ("NPP_MODEL", "Primary production, modelled", "mg/m3/day", BIOGEOCHEMISTRY),
)
_STATIC = (("DEPTH", "Seafloor depth", "m", ETOPO), ("SLOPE", "Seafloor slope", "degrees", ETOPO), ("ASPECT", "Seafloor aspect", "degrees", ETOPO))
_CLIMATE = ("NAO", "AMO", "AO", "PDO", "ONI")

#: Depth range in metres that gridded covariates are taken from.
SURFACE = (0, 1)

#: Species a run can name, with the prefix of their columns.
SPECIES = {k: {"prefix": prefix, "threshold": {"method": "percentile", "value": 0.9}} for k, prefix in (("cfin", "cfin"), ("ctyp", "ctyp"), ("pcal", "pseudo"))}


@dataclass(frozen=True)
class Covariate:
    name: str
    label: str
    units: str
    kind: str
    dataset: str = ""
    depth: tuple[int, int] | None = None

    @property
    def resolution(self) -> tuple[float | None, str | None]:
        """(degrees, period) from the data set's name."""
        return dataset_resolution(self.dataset)


def gridded() -> dict[str, Covariate]:
    return {n: Covariate(n, label, units, "gridded", source, SURFACE) for n, label, units, source in _GRIDDED}


def static() -> dict[str, Covariate]:
    return {n: Covariate(n, label, units, "static", source) for n, label, units, source in _STATIC}


def climate() -> dict[str, Covariate]:
    return {n: Covariate(n, f"{n} index", "", "climate", "monthly series") for n in _CLIMATE}


def info(derived: bool = True) -> list[Covariate]:
    """All covariates; derived: day of year and the derived steps too."""
    from .config import STEPS

    out = [*gridded().values(), *static().values(), *climate().values()]
    if derived:
        out.append(Covariate("jday", "Day of year", "day (1-366)", "derived", "the date of the observation"))
        out += [Covariate(s, s.replace("_", " ").capitalize(), "", "derived", "the covariate grid") for s in sorted(STEPS)]
    return out


def units(name: str) -> str:
    return next((c.units for c in info() if c.name == name), "")


def label(name: str) -> str:
    """The name with its long form, if it has one."""
    return next((f"{name} - {c.label}" for c in info() if c.name == name), name)


def axis(name: str) -> str:
    """The name with its units, if it has any."""
    return f"{name} ({units(name)})" if units(name) else name


def ramp(low: float | None, high: float | None) -> list[float]:
    """Six places of a colour ramp over novelty from low to high, with a break at zero that stays inside 2 to 98 %."""
    if low is None or high is None or not math.isfinite(low) or not math.isfinite(high) or high <= low:
        return [i / 5 for i in range(6)]
    zero = min(max(-low / (high - low), 0.02), 0.98)
    return [0.0, zero / 2, zero * 0.95, zero, zero + (1 - zero) / 2, 1.0]
