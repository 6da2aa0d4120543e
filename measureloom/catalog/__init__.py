"""Runnable queries over the supplied tables, each with the SQL it has to agree with."""

from measureloom.catalog import (  # noqa: F401
    aggregations, comparisons, lineage, profiling, quality, references, scalars, scope, shapes,
    sources, statistics,
)
from measureloom.catalog import lifecycle  # noqa: F401, E402  (needs the SQL of the others)
from measureloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
