"""The registry of the engine's own queries and their oracle statements."""

from __future__ import annotations

from . import analyses, checks, clustering, incremental, models, ranking, records

_PARTS = (clustering, ranking, incremental, records, analyses, checks)
QUERIES: dict = {k: v for part in (*_PARTS, models) for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}


def flagship(spark, sf_dir):
    """One clustering pass with its quality metrics."""
    return QUERIES["sfcm_quality"](spark, sf_dir)
