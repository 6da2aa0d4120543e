"""Profile a table and draft its contract."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measureloom.contract import Measure, Roles
from measureloom.operators import profiling
from measureloom.session import cut_lineage


@dataclass(frozen=True)
class Draft:
    """Profile, drafted measures and suggestions of one table. All frames are tiny."""

    roles: DataFrame
    measures: DataFrame
    dimensions: DataFrame
    coverage: DataFrame | None
    suggestions: DataFrame

    def to_roles(self) -> Roles:
        """The drafted roles as configuration: one row per column of the table is collected."""
        rows = self.roles.orderBy("position").select("role", "column").collect()
        dims = [r[0] for r in self.dimensions.orderBy("position").select("column").collect()]

        def first(role: str) -> str | None:
            return next((r["column"] for r in rows if r["role"] == role), None)

        return Roles(time=first("time"), dimensions=tuple(dims), customer=first("customer"),
                     product=first("product"), target=first("target"), id=first("id"))

    def to_measures(self) -> list[Measure]:
        """The drafted measures; percent scales still have to be confirmed by the caller."""
        return [Measure(r["id"], r["field"], r["aggregation"], r["unit"], r["direction"],
                        r["additivity"], r["semantic_type"], primary=r["primary"])
                for r in self.measures.collect()]


def draft(df: DataFrame, approximate: bool = False, timezone: str | None = None) -> Draft:
    """Profile ``df`` once and derive roles, measures, dimensions and suggestions from it."""
    roles = cut_lineage(profiling.infer_roles(profiling.column_profile(df, approximate)))
    time = roles.where(F.col("role") == "time").orderBy("position").head()
    coverage = profiling.time_coverage(df, time["column"], timezone) if time else None
    return Draft(roles, profiling.infer_measures(roles), profiling.candidate_dimensions(roles),
                 coverage, profiling.suggested_analyses(roles, coverage))
