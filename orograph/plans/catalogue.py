"""Every query of the engine and the SQL that checks it."""

from __future__ import annotations

from orograph.plans import city, colours, rasters, records, regions, scalars, scaling, scans, scoring, structures, terrain

MODULES = [scoring, rasters, scaling, regions, records, structures, scalars, scans, city, terrain, colours]


def queries() -> dict:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
