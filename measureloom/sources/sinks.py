"""Writers of results and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result table; the commit protocol publishes all files or none."""
    if fmt not in ("parquet", "json"):
        raise ValueError("format is parquet or json")
    df.write.mode("overwrite").format(fmt).save(path)


def findings_markdown(findings: DataFrame) -> DataFrame:
    """Findings as ordered markdown lines, errors first."""
    title = F.when(F.col("severity") == "error", "BLOCKED").otherwise("WARN")
    amount = F.when(F.col("value").isNotNull(),
                    F.concat(F.lit(" = "), F.round("value", 4).cast("string"))).otherwise("")
    limit = F.when(F.col("threshold").isNotNull(),
                   F.concat(F.lit(" (limit "), F.col("threshold").cast("string"), F.lit(")"))
                   ).otherwise("")
    line = F.concat(F.lit("- **"), title, F.lit("** "), F.col("code"), F.lit(": "),
                    F.col("subject"), amount, limit)
    return findings.select("severity", "code", "subject", line.alias("line"))


def write_findings(findings: DataFrame, path: str) -> None:
    """Write the findings report as text, one line each, in one ordered file."""
    lines = findings_markdown(findings).orderBy(
        F.when(F.col("severity") == "error", 0).otherwise(1), "code", "subject")
    lines.select("line").coalesce(1).write.mode("overwrite").text(path)
