"""SQLite and DuckDB tables through the Python Data Source API.

A path is one database file or a folder of files with the same table. Every table is cut into
ranges of its row id; each Spark task opens its file read-only and streams its range as Arrow
batches. The path has to be one that every executor can read.
"""

from __future__ import annotations

import decimal
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema
from pyspark.sql.types import (
    BinaryType, DoubleType, LongType, StringType, StructField, StructType,
)

ROWS_PER_BATCH = 10_000


def quoted(name: str) -> str:
    """SQL identifier, safe for any table name."""
    if not name or "\0" in name:
        raise ValueError("table name is empty or malformed")
    return '"' + name.replace('"', '""') + '"'


@dataclass
class RowRange(InputPartition):
    """Closed row-id range of one file; without bounds the whole table."""

    file: str
    low: int | None = None
    high: int | None = None


def ranges(file: str, low: int | None, high: int | None, parts: int) -> list[RowRange]:
    if low is None or high is None:
        return [RowRange(file)]
    step = max(1, -(-(high - low + 1) // parts))
    return [RowRange(file, start, min(high, start + step - 1))
            for start in range(low, high + 1, step)]


def database_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    if not os.path.isdir(path):
        return [path]
    found = sorted(e.path for e in os.scandir(path) if e.name.endswith(suffixes))
    if not found:
        raise ValueError(f"no {'/'.join(suffixes)} files in {path}")
    return found


class _Reader(DataSourceReader):
    def __init__(self, source, schema: StructType):
        self.files, self.table, self.parts = source.files, source.table, source.parts
        self.schema = schema

    def _select(self, part: RowRange) -> str:
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        where = "" if part.low is None else f" WHERE rowid BETWEEN {part.low} AND {part.high}"
        return f"SELECT {columns} FROM {quoted(self.table)}{where}"

    def _bounds(self, file: str) -> tuple[int | None, int | None]:
        raise NotImplementedError

    def _columns(self, file: str) -> list[str]:
        raise NotImplementedError

    def partitions(self):
        names = {f.name for f in self.schema.fields}
        for file in self.files[1:]:
            if more := sorted(set(self._columns(file)) - names):
                raise ValueError(f"{os.path.basename(file)} has columns that the first file lacks: {more}")
        return [r for file in self.files for r in ranges(file, *self._bounds(file), self.parts)]


class _Source(DataSource):
    """Options: path, table, partitions (per file)."""

    suffixes: tuple[str, ...] = ()

    def __init__(self, options):
        super().__init__(options)
        path = self.options.get("path")
        if not path:
            raise ValueError("option path is required")
        self.files = database_files(path, self.suffixes)
        self.table = self.options.get("table")
        self.parts = max(1, int(self.options.get("partitions", "8")))
        if not self.table:
            raise ValueError(f"option table is required; the file has {self.tables()}")

    def tables(self) -> list[str]:
        raise NotImplementedError


# --- SQLite ------------------------------------------------------------------------------------

def _sqlite(path: str):
    import sqlite3
    from urllib.parse import quote

    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _sqlite_type(declared: str):
    """Spark type of a declared column type; pass a schema to read a column differently."""
    text = declared.upper()
    if "INT" in text:
        return LongType()
    if any(k in text for k in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in text else StringType()


class SQLiteReader(_Reader):
    def _columns(self, file):
        con = _sqlite(file)
        try:
            return [r[1] for r in con.execute(f"PRAGMA table_info({quoted(self.table)})")]
        finally:
            con.close()

    def _bounds(self, file):
        con = _sqlite(file)
        try:
            return con.execute(
                f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except Exception:  # views and WITHOUT ROWID tables have no row id
            return None, None
        finally:
            con.close()

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        con = _sqlite(partition.file)
        try:
            cursor = con.execute(self._select(partition))
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                columns = [
                    pa.array([_as(f, v) for v in values], type=arrow.field(i).type)
                    for i, (f, values) in enumerate(zip(self.schema.fields, zip(*rows)))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            con.close()


def _as(field: StructField, value):
    if value is None:
        return None
    kind = field.dataType
    if isinstance(kind, StringType):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if isinstance(kind, DoubleType) and isinstance(value, (int, float)):
        return float(value)
    if isinstance(kind, LongType) and not isinstance(value, int):
        raise ValueError(f"column {field.name!r} is declared integer but holds {value!r}; "
                         "read it with an explicit schema")
    return value


class SQLiteSource(_Source):
    @classmethod
    def name(cls):
        return "sqlite_table"

    suffixes = (".sqlite", ".sqlite3", ".db")

    def tables(self):
        con = _sqlite(self.files[0])
        try:
            return [r[0] for r in con.execute(
                "SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
        finally:
            con.close()

    def schema(self):
        con = _sqlite(self.files[0])
        try:
            info = con.execute(f"PRAGMA table_info({quoted(self.table)})").fetchall()
        finally:
            con.close()
        if not info:
            raise ValueError(f"no table {self.table!r}; the file has {self.tables()}")
        return StructType([StructField(name, _sqlite_type(declared or ""))
                           for _, name, declared, *_rest in info])

    def reader(self, schema):
        return SQLiteReader(self, schema)


# --- DuckDB ------------------------------------------------------------------------------------

def _duckdb(path: str):
    try:
        import duckdb
    except ImportError as exc:
        raise ImportError("reading a DuckDB file needs the duckdb package on every node") from exc
    return duckdb.connect(path, read_only=True)


class DuckDBReader(_Reader):
    def _columns(self, file):
        con = _duckdb(file)
        try:
            return [r[0] for r in con.execute(f"DESCRIBE SELECT * FROM {quoted(self.table)}").fetchall()]
        finally:
            con.close()

    def _bounds(self, file):
        con = _duckdb(file)
        try:
            return con.execute(
                f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchall()[0]
        except Exception:  # views have no row id
            return None, None
        finally:
            con.close()

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        con = _duckdb(partition.file)
        try:
            cursor = con.execute(self._select(partition))
            while rows := cursor.fetchmany(ROWS_PER_BATCH):
                arrays = [pa.array([_plain(v) for v in values], type=target.field(i).type)
                          for i, values in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        finally:
            con.close()


def _plain(value):
    return float(value) if isinstance(value, decimal.Decimal) else value


# DuckDB type names and the Arrow types that carry them.
_DUCK_TYPES = {
    "TINYINT": pa.int8(), "SMALLINT": pa.int16(), "INTEGER": pa.int32(), "BIGINT": pa.int64(),
    "UTINYINT": pa.int16(), "USMALLINT": pa.int32(), "UINTEGER": pa.int64(),
    "FLOAT": pa.float32(), "DOUBLE": pa.float64(), "HUGEINT": pa.float64(),
    "UBIGINT": pa.float64(), "BOOLEAN": pa.bool_(), "VARCHAR": pa.string(), "BLOB": pa.binary(),
    "DATE": pa.date32(), "TIMESTAMP": pa.timestamp("us"),
}


class DuckDBSource(_Source):
    @classmethod
    def name(cls):
        return "duckdb_table"

    suffixes = (".duckdb", ".ddb")

    def tables(self):
        con = _duckdb(self.files[0])
        try:
            return [r[0] for r in con.execute(
                "SELECT table_name FROM information_schema.tables").fetchall()]
        finally:
            con.close()

    def schema(self):
        con = _duckdb(self.files[0])
        try:
            described = con.execute(f"DESCRIBE SELECT * FROM {quoted(self.table)}").fetchall()
        finally:
            con.close()
        fields = []
        for name, kind, *_rest in described:
            base = kind.split("(")[0].upper()
            arrow = pa.float64() if base == "DECIMAL" else _DUCK_TYPES.get(base)
            if arrow is None:
                raise ValueError(f"column {name!r} of type {kind} is not supported; cast it in a view")
            fields.append(StructField(name, from_arrow_type(arrow)))
        return StructType(fields)

    def reader(self, schema):
        return DuckDBReader(self, schema)


def _read(spark: SparkSession, source, path: str, table: str | None, partitions: int) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path).option(
        "partitions", str(partitions))
    if table:
        reader = reader.option("table", table)
    return reader.load()


def read_sqlite(spark: SparkSession, path: str, table: str | None, partitions: int = 8) -> DataFrame:
    return _read(spark, SQLiteSource, path, table, partitions)


def read_duckdb(spark: SparkSession, path: str, table: str | None, partitions: int = 8) -> DataFrame:
    return _read(spark, DuckDBSource, path, table, partitions)
