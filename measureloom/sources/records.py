"""Records of delimited text whose quoted cells may hold line breaks, by many tasks per file.

Whether a line break ends a record depends on everything before it in the file. A line only maps
the state it begins in (outside or inside a quoted cell) to the state it ends in, so each task can
give both answers for its byte range; composing the ranges of a file in order tells where each
range really begins, and the records of all ranges are then cut at once. Only pieces of records
that cross a border of ranges are brought together, by record.

Lines end with a line feed, or carriage return and line feed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from measureloom.session import cut_lineage

_FRESH, _PLAIN, _QUOTED, _CLOSED = range(4)
#: Which part of a record a row of ``pieces`` is.
WHOLE, HEAD, TAIL, MIDDLE = range(4)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside or outside one.

    A quote opens a cell only as its first character, a doubled quote inside stays inside, and what
    follows a closing quote up to the separator is plain.
    """
    state = _QUOTED if inside else _FRESH
    for piece in line.split('"')[:-1]:
        if state == _QUOTED:
            state = _CLOSED
        elif piece:
            state = _QUOTED if piece.endswith(sep) else _PLAIN
        elif state != _PLAIN:
            state = _QUOTED
    return state == _QUOTED


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines, and which byte range of which file they were read from."""
    return spark.read.text(path, lineSep="\n").select(
        "value", F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, tuple[int, int]]]:
    """Runs of rows of one range: first row, row after the last, (file, start)."""
    file, start = (batch.column(k).to_numpy() for k in ("file", "start"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if a < b:
            yield a, b, (int(file[a]), int(start[a]))


def _answers(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out, inn, opened = None, False, True, False
        for batch in batches:
            quoted = batch.column("quoted")
            for a, b, here in _stretches(batch):
                if here != key:
                    if key is not None:
                        yield _answer(key, out, inn, opened)
                    key, out, inn, opened = here, False, True, False
                for line in quoted.slice(a, b - a).drop_null().to_pylist():
                    same = out == inn
                    out = ends_inside(line, out, sep)
                    inn = out if same else ends_inside(line, inn, sep)
                    opened |= out
        if key is not None:
            yield _answer(key, out, inn, opened)

    return run


def _answer(key, out, inn, opened) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file": [key[0]], "start": [key[1]], "when_outside": [out],
                                       "when_inside": [inn], "opened": [opened]})


def answers(lines: DataFrame, sep: str) -> DataFrame:
    """Per byte range (file, start): the state at its end when it begins outside, and inside, a cell.

    ``opened`` tells whether any of its lines leaves a cell open when it begins outside. Lines
    without a quote change nothing, so their text does not leave the engine.
    """
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value")).alias("quoted")
    return lines.select(quoted, "file", "start").mapInArrow(
        _answers(sep), "file bigint, start bigint, when_outside boolean, when_inside boolean, opened boolean")


def beginnings(found: DataFrame) -> DataFrame:
    """(file, start, inside): the state in which every byte range begins.

    A range either fixes the state, flips it or leaves it: the state after a range is what the last
    fixing range left, flipped as often as ranges since then flip. Ranges of a file are as many as
    its size allows, one row each.
    """
    upto = W.partitionBy("file").orderBy("start")
    flips = F.sum((F.col("when_outside") & ~F.col("when_inside")).cast("int")).over(upto) % 2
    fixes = F.col("when_outside") == F.col("when_inside")
    state = found.withColumn("_flips", flips).withColumn(
        "_left", F.last(F.when(fixes, F.col("when_outside").cast("int").bitwiseXOR(F.col("_flips"))), True).over(upto))
    after = F.coalesce("_left", F.lit(0)).bitwiseXOR(F.col("_flips")) == 1
    return state.select("file", "start", F.coalesce(F.lag(after).over(upto), F.lit(False)).alias("inside"))


def _cut(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, head, held, first = None, False, False, [], False
        out: list[tuple] = []

        def put(part: int):
            nonlocal first, held
            out.append((*key, part, first, "\n".join(held)))
            first, held = False, []

        def rest():
            if held:
                put((MIDDLE if head else TAIL) if inside else WHOLE)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)],
                names=["file", "start", "part", "first", "record"])

        for batch in batches:
            value = batch.column("value")
            marked = pc.match_substring(value, '"')
            for a, b, here in _stretches(batch):
                if here != key:
                    rest()
                    key, held = here, []
                    inside = head = batch.column("inside")[a].as_py()
                    first = here[1] == 0
                lines, marks = value.slice(a, b - a), marked.slice(a, b - a)
                if not inside and not first and not pc.any(marks).as_py():
                    if out:
                        yield flushed()
                    n = len(lines)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.full(n, WHOLE, np.int32)),
                         pa.array(np.zeros(n, bool)), lines], names=["file", "start", "part", "first", "record"])
                    continue
                for line, mark in zip(lines.to_pylist(), marks.to_pylist(), strict=True):
                    held.append(line)
                    inside = ends_inside(line, inside, sep) if mark else inside
                    if not inside:
                        put(HEAD if head else WHOLE)
                        head = False
            if out:
                yield flushed()
        rest()
        if out:
            yield flushed()

    return run


def records(spark: SparkSession, path: str, sep: str, found: DataFrame, header: bool) -> DataFrame:
    """(record): every record that is not blank, without the first of each file if that is a header.

    ``found`` are the answers of the same ranges; they are as many as the driver schedules tasks for,
    so that the states may be broadcast. The records are written once.
    """
    states = F.broadcast(beginnings(found))
    lines = lines_of(spark, path).join(states, ["file", "start"], "left")
    known = F.coalesce("inside", F.raise_error(F.lit("the ranges of a file changed between two scans")).cast("boolean"))
    pieces = cut_lineage(lines.select("value", "file", "start", known.alias("inside")).mapInArrow(
        _cut(sep), "file bigint, start bigint, part int, first boolean, record string"))
    parts = pieces.where(F.col("part") != WHOLE)
    # In a range, the head of the record before comes first and the tail of the record after last.
    order = W.partitionBy("file").orderBy("start", "part")
    crossing = parts.withColumn("_nr", F.sum((F.col("part") == TAIL).cast("int")).over(order)).groupBy("file", "_nr").agg(
        F.bool_or("first").alias("first"), F.concat_ws("\n", F.transform(
            F.array_sort(F.collect_list(F.struct("start", "part", "record"))), lambda s: s["record"])).alias("record"))
    every = pieces.where(F.col("part") == WHOLE).select("first", "record").unionByName(crossing.select("first", "record"))
    text = F.regexp_replace("record", r"\r\z", "").alias("record")
    kept = every.where(~F.col("first")) if header else every
    return kept.select(text).where(F.trim("record") != "")


def cells(record: Column, count: int, sep: str) -> Column:
    """The cells c0, c1, … of a record as text."""
    return F.from_csv(record, ", ".join(f"c{k} string" for k in range(count)), csv_options(sep))


def csv_options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}


def pinned_ranges(spark: SparkSession) -> Sequence[tuple[str, str | None]]:
    """Hold what byte ranges depend on besides the files; gives what to restore."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    return [(name, before)]


def restore(spark: SparkSession, held: Sequence[tuple[str, str | None]]) -> None:
    for name, before in held:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
