"""Whole lifecycles composed of operators."""

from measureloom.plans.draft import Draft, draft
from measureloom.plans.insights import Insights, derive_insights
from measureloom.plans.report import Contract, Report, build_report, save_report

__all__ = [
    "Contract", "Draft", "Insights", "Report", "build_report", "derive_insights", "draft",
    "save_report",
]
