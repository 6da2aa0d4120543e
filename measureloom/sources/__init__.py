"""Readers and writers."""

from measureloom.sources.files import load, read_csv, read_parquet, read_sql
from measureloom.sources.fingerprint import file_fingerprints, source_fingerprint, sql_fingerprint
from measureloom.sources.sinks import write_findings, write_metrics

__all__ = [
    "file_fingerprints", "load", "read_csv", "read_parquet", "read_sql", "source_fingerprint",
    "sql_fingerprint", "write_findings", "write_metrics",
]
