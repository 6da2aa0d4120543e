"""Text, Parquet and SQL sources, and one entry point for all kinds."""

from __future__ import annotations

import csv
import io
import os
import re

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measureloom.contract import NUMERIC_FIELD_TYPES, TIME_FIELD_TYPES, SchemaContract
from measureloom.functions.cleaning import OFFSET_PATTERN
from measureloom.session import cut_lineage
from measureloom.sources import records

_SEPARATORS = (",", "\t", ";", "|")
_SQLITE, _DUCKDB = (".sqlite", ".sqlite3", ".db"), (".duckdb", ".ddb")
_EXCEL, _TEXT, _PARQUET = (".xlsx", ".xlsm", ".xls"), (".csv", ".tsv", ".txt"), (".parquet", ".pq")


#: Lines looked at to learn the form of a text source.
SAMPLE_LINES = 500
_NUMBER_OR_DAY = re.compile(r"[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?%?|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}.*")


def sample_lines(spark: SparkSession, path: str, n: int = SAMPLE_LINES) -> list[str]:
    """First lines of a text source."""
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def outside_quotes(text: str) -> str:
    """The text without its quoted parts; a doubled quote stays inside."""
    return re.sub(r'"(?:[^"]|"")*(?:"|$)', "", text)


def sniff_separator(line: str) -> str:
    """The candidate separator the header line uses most, outside quotes."""
    bare = outside_quotes(line)
    return max(_SEPARATORS, key=lambda s: (bare.count(s), -_SEPARATORS.index(s)))


def first_record(lines: list[str], sep: str) -> list[str]:
    """Cells of the first record, which may span lines."""
    return next(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep), [])


def has_header(lines: list[str], sep: str) -> bool:
    """A header has no cell that reads as a number or a day, no blank and no repeated cell."""
    cells = [c.strip() for c in first_record(lines, sep)]
    return (bool(cells) and all(cells) and len(set(cells)) == len(cells)
            and not any(_NUMBER_OR_DAY.fullmatch(c) for c in cells))


def declared_schema(names: list[str], contract: SchemaContract) -> T.StructType:
    """Reader schema: text unless the contract declares a type that Spark parses losslessly."""
    kinds = {"integer": T.LongType(), "int": T.LongType()}
    kinds.update({k: T.DoubleType() for k in NUMERIC_FIELD_TYPES if k not in kinds})
    kinds.update({k: T.TimestampType() for k in TIME_FIELD_TYPES})
    return T.StructType([
        T.StructField(n, kinds.get((contract.fields[n].type or "").lower(), T.StringType())
                      if n in contract.fields else T.StringType()) for n in names])


_WHOLE_NUMBER = r"^[+-]?\d+$"
_DECIMAL_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DAY, _TIME = r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{4}-\d{1,2}-\d{1,2}[ T].+$"


def type_counts(cell: Column, name: str) -> list[Column]:
    """Aggregates of one text column that tell its type."""
    day = cell.rlike(_DAY) & F.try_to_date(cell).isNotNull()
    time = cell.rlike(_TIME) & F.try_to_timestamp(cell).isNotNull()
    kinds = {"n": cell.isNotNull(), "int": cell.rlike(_WHOLE_NUMBER) & cell.try_cast("int").isNotNull(),
             "long": cell.rlike(_WHOLE_NUMBER) & cell.try_cast("long").isNotNull(),
             "whole": cell.rlike(_WHOLE_NUMBER), "double": cell.rlike(_DECIMAL_NUMBER), "day": day, "time": day | time,
             "zoned": cell.rlike(OFFSET_PATTERN), "flag": F.lower(cell).isin("true", "false")}
    return [F.count_if(test).alias(f"{name}_{k}") for k, test in kinds.items()] + [
        F.max(F.length(cell)).alias(f"{name}_size")]


def type_of(counts: dict, name: str) -> T.DataType:
    """The narrowest type that reads every cell; text where there is no cell."""
    def all_are(kind: str) -> bool:
        return counts[f"{name}_n"] > 0 and counts[f"{name}_{kind}"] == counts[f"{name}_n"]

    if all_are("int"):
        return T.IntegerType()
    if all_are("long"):
        return T.LongType()
    if all_are("whole") and counts[f"{name}_size"] <= 38:
        return T.DecimalType(counts[f"{name}_size"], 0)
    if all_are("double"):
        return T.DoubleType()
    if all_are("day"):
        return T.DateType()
    if all_are("time"):
        return T.TimestampType() if counts[f"{name}_zoned"] else T.TimestampNTZType()
    return T.BooleanType() if all_are("flag") else T.StringType()


def read_csv(spark: SparkSession, path: str, sep: str | None = None,
             contract: SchemaContract | None = None, as_text: bool = False,
             header: bool | None = None, multiline: bool | None = None) -> DataFrame:
    """CSV, TSV or TXT; quotes are doubled inside quoted cells.

    Separator and header are taken from the first lines when not given. Columns of a source without
    header are column0, column1 and so on. One scan tells whether a quoted cell holds a line break
    and, at once, the types of the cells; types are taken from it unless a contract declares fields
    or ``as_text`` keeps every cell for the cleaning functions. Times without an offset are read
    without a zone: they are business time. A source with quoted breaks is cut into records by many
    tasks per file in a second scan, which is written, since nothing else could be read in parts.
    """
    lines = sample_lines(spark, path)
    sep = sep or sniff_separator(lines[0] if lines else "")
    header = (not lines or has_header(lines, sep)) if header is None else header

    def reader(**more) -> DataFrameReader:
        return spark.read.options(header=header, sep=sep, quote='"', escape='"', **more)

    text = reader(inferSchema=False, multiLine=True).csv(path)
    names = [n.removesuffix("\r") for n in text.columns] if header else [f"column{k}" for k in range(len(text.columns))]
    found, counts, held = None, {}, records.pinned_ranges(spark)
    try:
        if multiline is not False:
            found, counts = _survey(spark, path, sep, lines[0] if header and lines else None, 0 if as_text else len(names))
        if multiline or (found is not None and not found.where("opened").isEmpty()):
            cut = records.records(spark, path, sep, found, header)
            parsed = cut.select(records.cells(F.col("record"), len(names), sep).alias("r"))
            counts = {} if as_text else _observed(parsed, len(names))
            schema = _schema(names, counts, contract, as_text)
            if not names:
                return spark.createDataFrame([], schema)
            kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(schema.fields))
            typed = cut.select(F.from_csv("record", kinds, records.csv_options(sep)).alias("r"))
            return typed.select(*[F.col(f"r.c{k}").alias(n) for k, n in enumerate(names)])
    finally:
        records.restore(spark, held)
    if found is None and not as_text:
        counts = _observed(reader(inferSchema=False).csv(path).toDF(*[f"c{k}" for k in range(len(names))]).select(
            F.struct("*").alias("r")), len(names))
    if not names:
        return reader().csv(path)
    return reader().schema(_schema(names, counts, contract, as_text)).csv(path)


def _survey(spark: SparkSession, path: str, sep: str, header_line: str | None, count: int) -> tuple[DataFrame, dict]:
    """Answers of all byte ranges about quoted breaks, and type counts of so many columns, in one scan."""
    lines, seen = records.lines_of(spark, path), None
    if count:
        value = F.regexp_replace("value", r"\r\z", "")
        own = value if header_line is None else F.when(~((value == header_line) & (F.col("start") == 0)), value)
        parsed = records.cells(own, count, sep)
        seen = Observation()
        lines = lines.withColumn("_r", parsed).observe(
            seen, *[c for k in range(count) for c in type_counts(F.col(f"_r.c{k}"), f"c{k}")])
    found = cut_lineage(records.answers(lines, sep))
    return found, (seen.get if seen else {})


def _observed(parsed: DataFrame, count: int) -> dict:
    if not count:
        return {}
    return parsed.agg(*[c for k in range(count) for c in type_counts(F.col(f"r.c{k}"), f"c{k}")]).head().asDict()


def _schema(names: list[str], counts: dict, contract: SchemaContract | None, as_text: bool) -> T.StructType:
    if as_text:
        return T.StructType([T.StructField(n, T.StringType()) for n in names])
    if contract and contract.fields:
        declared = declared_schema(names, contract)
        return T.StructType([T.StructField(
            f.name, T.TimestampNTZType() if isinstance(f.dataType, T.TimestampType) and not counts[f"c{k}_zoned"]
            else f.dataType) for k, f in enumerate(declared.fields)])
    return T.StructType([T.StructField(n, type_of(counts, f"c{k}")) for k, n in enumerate(names)])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_sql(spark: SparkSession, text: str) -> DataFrame:
    """Any query over registered tables and views."""
    return spark.sql(text)


def load(spark: SparkSession, path: str | None = None, sql: str | None = None,
         table: str | None = None, sheet: str | None = None,
         contract: SchemaContract | None = None) -> DataFrame:
    """Open a source by query text or by file extension."""
    if sql is not None:
        return read_sql(spark, sql)
    if path is None:
        raise ValueError("give a path or a query")
    kind = os.path.splitext(path)[1].lower()
    if kind in _TEXT:
        return read_csv(spark, path, contract=contract)
    if kind in _PARQUET:
        return read_parquet(spark, path)
    if kind in _SQLITE or kind in _DUCKDB:
        from measureloom.sources.databases import read_duckdb, read_sqlite

        return (read_sqlite if kind in _SQLITE else read_duckdb)(spark, path, table)
    if kind in _EXCEL:
        from measureloom.sources.excel import read_excel

        return read_excel(spark, path, sheet)
    raise ValueError(f"source type {kind!r} is not supported")
