"""Business-measure analytics as Spark DataFrame operators."""

from measureloom.contract import (
    Measure,
    Reference,
    Roles,
    SchemaContract,
    Scope,
    Thresholds,
)

__all__ = ["Measure", "Reference", "Roles", "SchemaContract", "Scope", "Thresholds"]
__version__ = "0.1.0"
