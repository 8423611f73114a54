"""The query catalogue: every operator as a named query, with SQL where SQL can say it."""
from __future__ import annotations

from . import maps, pipeline, series, streams, training

_MODULES = (maps, series, streams, training, pipeline)


def core_queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.queries().items()}


def core_oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.oracle_sql().items()}


def flagship(spark, sf_dir):
    """Best-matching units of all records on their own maps, and the quality of each map."""
    return maps.map_quality(spark, sf_dir)
