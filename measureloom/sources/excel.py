"""Excel sheets through the Python Data Source API: one task per (workbook, sheet)."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

_PATTERNS = ("*.xlsx", "*.xlsm", "*.xls")


def _workbooks(path: str) -> list[str]:
    """The workbook itself, or all workbooks of a folder."""
    if not os.path.isdir(path):
        return [path]
    return sorted(f for p in _PATTERNS for f in glob.glob(os.path.join(path, p)))


def _pandas():
    try:
        import openpyxl  # noqa: F401
    except ImportError as exc:
        raise ImportError("reading Excel needs the openpyxl package on every node") from exc
    import pandas as pd

    return pd


@dataclass
class Sheet(InputPartition):
    workbook: str
    sheet: str


class ExcelReader(DataSourceReader):
    def __init__(self, source, schema: StructType):
        self.schema = schema
        self.sheets = source.sheets()

    def partitions(self):
        return self.sheets

    def read(self, partition: Sheet) -> Iterator[tuple]:
        pd = _pandas()
        frame = pd.read_excel(partition.workbook, sheet_name=partition.sheet)
        frame.columns = [str(c) for c in frame.columns]
        names = [f.name for f in self.schema.fields]
        if more := sorted(set(frame.columns) - set(names)):
            raise ValueError(f"{os.path.basename(partition.workbook)} has columns that the first workbook lacks: {more}")
        for row in frame.reindex(columns=names).itertuples(index=False, name=None):
            yield tuple(_cell(f.dataType, v, pd) for f, v in zip(self.schema.fields, row))


def _cell(kind, value, pd):
    if pd.isna(value):
        return None
    if isinstance(kind, DoubleType):
        return float(value)
    if isinstance(kind, TimestampType):
        return pd.Timestamp(value).to_pydatetime()
    return str(value)


class ExcelSource(DataSource):
    """Options: path (a workbook or a folder of workbooks) and sheet (the first one otherwise)."""

    @classmethod
    def name(cls):
        return "excel_sheet"

    def sheets(self) -> list[Sheet]:
        pd = _pandas()
        wanted = self.options.get("sheet")
        found = []
        for book in _workbooks(self.options["path"]):
            with pd.ExcelFile(book) as handle:
                names = handle.sheet_names
            if wanted and wanted not in names:
                raise ValueError(f"{os.path.basename(book)} has no sheet {wanted!r}: {names}")
            found.append(Sheet(book, wanted or names[0]))
        return found

    def schema(self):
        pd = _pandas()
        first = self.sheets()[0]
        frame = pd.read_excel(first.workbook, sheet_name=first.sheet)
        fields = []
        for name, kind in frame.dtypes.items():
            if pd.api.types.is_bool_dtype(kind) or not (
                    pd.api.types.is_numeric_dtype(kind)
                    or pd.api.types.is_datetime64_any_dtype(kind)):
                spark_type = StringType()
            else:
                spark_type = (DoubleType() if pd.api.types.is_numeric_dtype(kind)
                              else TimestampType())
            fields.append(StructField(str(name), spark_type))
        return StructType(fields)

    def reader(self, schema):
        return ExcelReader(self, schema)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    _pandas()
    spark.dataSource.register(ExcelSource)
    reader = spark.read.format(ExcelSource.name()).option("path", path)
    return (reader.option("sheet", sheet) if sheet else reader).load()
