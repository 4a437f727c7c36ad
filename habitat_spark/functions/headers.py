"""Header logic of station files: taxa, stages, units and names. Plain Python over column names."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from dataclasses import dataclass

#: Single stages in order, and the aliases of stage columns by taxon prefix.
STAGES = ("CI", "CII", "CIII", "CIV", "CV", "CVI")
ALIASES = {"cfin": {"adult": "CV_VI"}}
#: Shorthand of names that don't follow the rule; count suffixes' usual form.
SHORTHAND = {"pseudocalanus": "pcal"}
RAW_COLUMNS = ("LATITUDE", "LONGITUDE", "DATE")
CANONICAL_COLUMNS = ("lat", "lon", "year", "month", "day")
SUFFIX = re.compile(r"_(\d*)(M[23])$", re.I)
STAGE = re.compile(r"_((?:C?(?:VI|IV|V|I{1,3}))(?:_C?(?:VI|IV|V|I{1,3}))?|ADULT|TOTAL|C)$", re.I)


def is_raw_export(header: list[str]) -> bool:
    """A raw export has its own place and date columns and none of the canonical ones."""
    upper = {h.upper() for h in header}
    return all(c in upper for c in RAW_COLUMNS) and not any(h in CANONICAL_COLUMNS for h in header)


def abundance_units(suffix: str) -> tuple[int, str]:
    """(divisor, unit) of a suffix such as _10M2."""
    m = SUFFIX.search(suffix)
    if not m:
        raise ValueError(f"no count and unit in {suffix!r}")
    return int(m[1] or 1), m[2].upper()


#: Letters more than at first that short names may take until they differ.
LONGER = 13


def taxon_shorthands(taxa: list[str]) -> dict[str, str]:
    """Short names that are unique, whatever the taxa's case: names that come out alike get more letters of the first word."""
    words = {t: [w for w in re.split(r"[_\s]+", t.lower()) if w] for t in taxa}

    def name(taxon: str, more: int | None = None) -> str:
        first, *rest = words[taxon] or [""]
        if more is None and first in SHORTHAND:
            return SHORTHAND[first]
        if not rest:
            return first[: 4 if more is None else 6 + more]
        return first[: 1 if more is None else 3 + more] + rest[0][:3]

    names = {t: name(t) for t in words}
    groups: dict[str, list[str]] = {}
    for t, short in names.items():
        groups.setdefault(short, []).append(t)
    for short, members in groups.items():
        kinds = len({t.lower() for t in members})
        if kinds < 2:
            continue
        more = next((m for m in range(LONGER) if len({name(t, m) for t in members}) == kinds), None)
        if more is None:
            warnings.warn(f"taxa share the short name {short}: {', '.join(members)}", stacklevel=2)
        else:
            names |= {t: name(t, more) for t in members}
    return names


@dataclass(frozen=True)
class TaxonColumn:
    """A counted column of a raw export."""

    column: str
    taxon: str
    shorthand: str
    stage: str | None
    name: str
    per: int
    unit: str


def zoop_taxa(header: list[str], suffix: str = "_10M2") -> list[TaxonColumn]:
    """Columns with the suffix, by taxon and stage. A total has no stage."""
    found = []
    per, unit = abundance_units(suffix)
    for column in header:
        if not column.upper().endswith(suffix.upper()):
            continue
        stem = column[: -len(suffix)]
        m = STAGE.search(stem)
        taxon = stem[: m.start()] if m else stem
        stage = m[1].upper() if m else None
        found.append((column, taxon.upper(), None if stage == "TOTAL" else stage))
    short = taxon_shorthands([t for _, t, _ in found])
    return [TaxonColumn(c, t, short[t], s, f"{short[t]}_{s or 'total'}", per, unit) for c, t, s in found]


_STAGE_INSIDE = re.compile(r"_C(?:VI|IV|V|I{1,3})_", re.I)


def check_taxa(taxa: list[TaxonColumn], header: list[str]) -> None:
    """Two columns of one name are an error; what else the names leave in doubt is worth a warning each."""
    twice = [n for n, c in Counter(t.name for t in taxa).items() if c > 1]
    if twice:
        raise ValueError(f"columns have the same name: {', '.join(t.column for t in taxa if t.name in twice)}")
    names = {t.taxon for t in taxa}
    written: dict[str, set[str]] = {}
    for t in taxa:
        written.setdefault(t.taxon, set()).add(t.column[: len(t.taxon)])
    units = {m[0].upper() for h in header if (m := SUFFIX.search(h))}
    doubts = {
        "a stage stands inside the name, so these count as totals": [t.column for t in taxa if _STAGE_INSIDE.search(t.taxon + "_")],
        "one taxon is written in several ways": [x for ways in written.values() if len(ways) > 1 for x in sorted(ways)],
        "taxa begin the names of others, so their prefix takes in the others' columns": [n for n in sorted(names) if any(o.startswith(n + "_") for o in names)],
        "columns are counted in several units, of which one is read": sorted(units) if taxa and len(units) > 1 else [],
    }
    for doubt, found in doubts.items():
        if found:
            warnings.warn(f"{doubt}: {', '.join(found)}", stacklevel=2)


def raw_suffix(header: list[str]) -> str | None:
    """The most common count suffix, the first by name of equal ones."""
    counts = Counter(m[0] for h in header if (m := SUFFIX.search(h)))
    return min(counts, key=lambda s: (-counts[s], s)) if counts else None


def measurement_columns(header: list[str]) -> list[str]:
    """Columns that count something."""
    return [h for h in header if SUFFIX.search(h)]


def species_catalog(header: list[str]) -> dict[str, str]:
    """Taxon by short name, for the taxa of a raw export."""
    suffix = raw_suffix(header)
    return dict(sorted({t.shorthand: t.taxon for t in zoop_taxa(header, suffix)}.items())) if suffix else {}


def available_species(header: list[str]) -> list[str]:
    """Prefixes that have stage or total columns, sorted; short names of a raw export."""
    if is_raw_export(header):
        return sorted(species_catalog(header))
    out = {h.split("_")[0] for h in header if re.search(r"_(total|adult|C[IV]*(_C?[IV]+)?)$", h)}
    return sorted(out)


def stage_pool(header: list[str], prefix: str, single_only: bool = False) -> dict[str, str]:
    """Stage to column, without the total; single_only: single stages and aliases."""
    pool = {h[len(prefix) + 1 :]: h for h in header if h.startswith(prefix + "_") and not h.lower().endswith("_total")}
    if single_only:
        alias = ALIASES.get(prefix, {})
        pool = {s: c for s, c in pool.items() if s in STAGES or s in alias or s == "adult"}
        pool |= {a: f"{prefix}_{target}" for a, target in alias.items() if f"{prefix}_{target}" in header}
    return pool


def spans(stage: str, prefix: str = "") -> tuple[str, ...]:
    """Single stages that a stage column covers."""
    stage = ALIASES.get(prefix, {}).get(stage, stage)
    parts = [p if p.startswith("C") else "C" + p for p in stage.split("_")]
    if all(p in STAGES for p in parts):
        return STAGES[STAGES.index(parts[0]) : STAGES.index(parts[-1]) + 1]
    return (stage,)


def stage_columns(header: list[str], prefix: str, stages: list[str] | None = None) -> list[str]:
    """Columns to add up: the whole pool, combinations included, or the asked single stages."""
    pool = stage_pool(header, prefix)
    if not pool:
        raise ValueError(f"no stage columns for {prefix!r}")
    if not stages:
        return list(pool.values())
    single = stage_pool(header, prefix, single_only=True)
    unknown = [s for s in stages if s not in single]
    if unknown:
        raise ValueError(f"unknown stages for {prefix!r}: {', '.join(unknown)}")
    covered = Counter(x for s in stages for x in spans(s, prefix))
    twice = [s for s, n in covered.items() if n > 1]
    if twice:
        raise ValueError(f"stages overlap at {', '.join(twice)}")
    return [single[s] for s in stages]


def dataset_resolution(dataset: str) -> tuple[float | None, str | None]:
    """(degrees, period) from a data set's name: 0.083deg or 4km, and P1M or P1D."""
    deg, km = re.search(r"(\d+(?:\.\d+)?)deg", dataset), re.search(r"(\d+(?:\.\d+)?)km", dataset)
    period = re.search(r"P1[DMY]", dataset)
    size = float(deg[1]) if deg else float(km[1]) / 111.32 if km else None
    return size, period[0] if period else None
