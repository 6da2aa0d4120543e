import hashlib
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from measureloom.contract import FieldSpec, SchemaContract
from measureloom.sources import (
    file_fingerprints, load, read_csv, source_fingerprint, sql_fingerprint, write_findings,
    write_metrics,
)
from measureloom.sources.databases import read_duckdb, read_sqlite
from measureloom.sources.files import sniff_separator


@pytest.mark.parametrize("sep, suffix", [(",", "csv"), ("\t", "tsv"), (";", "txt"), ("|", "csv")])
def test_separators_and_types(spark, tmp_path, sep, suffix):
    path = tmp_path / f"x.{suffix}"
    path.write_text("\n".join(sep.join(r) for r in [
        ("date", "zone", "amount"), ("2025-01-01", "n", "1.5"), ("2025-01-02", "s", "2")]) + "\n")
    df = load(spark, str(path))
    assert [t for _, t in df.dtypes] == ["date", "string", "double"]
    assert df.agg(F.sum("amount")).head()[0] == 3.5


def test_declared_types_and_text(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,amount\n007,\"1,5\"\n")
    declared = SchemaContract(fields={"amount": FieldSpec(type="number")})
    assert dict(read_csv(spark, str(path), contract=declared).dtypes) == {
        "id": "string", "amount": "double"}
    assert read_csv(spark, str(path), as_text=True).head()["amount"] == "1,5"


def test_separator_choice():
    assert sniff_separator("a;b;c,d") == ";"
    assert sniff_separator("single") == ","


def test_sqlite_table_with_awkward_names(spark, tmp_path):
    path = tmp_path / "sales'quoted.sqlite"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "order-lines" ("the amount" INTEGER, price REAL, note TEXT)')
    con.executemany('INSERT INTO "order-lines" VALUES (?, ?, ?)',
                    [(i, i / 2, None if i % 3 else f"n{i}") for i in range(1000)])
    con.execute('DELETE FROM "order-lines" WHERE "the amount" BETWEEN 100 AND 500')
    con.execute('CREATE VIEW v AS SELECT price FROM "order-lines"')
    con.commit()
    con.close()
    df = read_sqlite(spark, str(path), "order-lines", partitions=4)
    assert df.rdd.getNumPartitions() == 4
    row = df.agg(F.count("*"), F.sum("the amount"), F.sum("price"), F.count("note")).head()
    kept = [i for i in range(1000) if not 100 <= i <= 500]
    assert tuple(row) == (599, sum(kept), sum(kept) / 2, sum(i % 3 == 0 for i in kept))
    assert load(spark, str(path), table="v").count() == 599


def test_table_is_required(spark, tmp_path):
    path = tmp_path / "x.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE only_one (a INTEGER)")
    con.close()
    with pytest.raises(Exception, match="only_one"):
        read_sqlite(spark, str(path), None).count()


def test_duckdb_table(spark, tmp_path):
    path = str(tmp_path / "sales'quoted.duckdb")
    con = duckdb.connect(path)
    con.execute('CREATE TABLE "order-lines" AS SELECT i::INTEGER AS amount, '
                "(i / 4)::DECIMAL(10, 2) AS price, DATE '2025-01-01' + i::INTEGER AS day, "
                "CASE WHEN i % 2 = 0 THEN 'x' END AS k FROM range(500) t(i)")
    con.close()
    df = read_duckdb(spark, path, "order-lines", partitions=3)
    assert dict(df.dtypes) == {"amount": "int", "price": "double", "day": "date", "k": "string"}
    row = df.agg(F.sum("amount"), F.sum("price"), F.max("day").cast("string"), F.count("k")).head()
    assert tuple(row) == (124750, 31187.5, "2026-05-15", 250)


def test_same_totals_from_every_source(spark, tmp_path):
    rows = [("2024-01-05", "北区", 100_000), ("2025-01-05", "北区", 120_000)]
    con = sqlite3.connect(tmp_path / "s.sqlite")
    con.execute("CREATE TABLE sales (date TEXT, zone TEXT, amount INTEGER)")
    con.executemany("INSERT INTO sales VALUES (?, ?, ?)", rows)
    con.commit()
    con.close()
    con = duckdb.connect(str(tmp_path / "s.duckdb"))
    con.execute("CREATE TABLE sales (date VARCHAR, zone VARCHAR, amount INTEGER)")
    con.executemany("INSERT INTO sales VALUES (?, ?, ?)", rows)
    con.close()
    frames = [load(spark, str(tmp_path / f"s.{k}"), table="sales") for k in ("sqlite", "duckdb")]
    got = [[tuple(r) for r in f.orderBy("date").collect()] for f in frames]
    assert got == [rows, rows]


def test_excel_needs_its_package(spark, tmp_path):
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="openpyxl"):
            load(spark, str(tmp_path / "x.xlsx"))
        return
    import pandas as pd

    for i in range(2):
        with pd.ExcelWriter(tmp_path / f"{i}.xlsx") as writer:
            pd.DataFrame({"amount": [1.0 + i], "zone": ["n"]}).to_excel(
                writer, sheet_name="Sales", index=False)
    from measureloom.sources.excel import read_excel

    assert read_excel(spark, str(tmp_path), "Sales").agg(F.sum("amount")).head()[0] == 3.0


def test_fingerprints(spark, tmp_path):
    one = tmp_path / "a file.csv"
    one.write_bytes(b"x" * 3_000_000)
    row = source_fingerprint(spark, str(one), "sheet").head()
    assert row["sha256"] == hashlib.sha256(one.read_bytes()).hexdigest()
    assert (row["name"], row["kind"], row["bytes"], row["selector"]) == (
        "a file.csv", "csv", 3_000_000, "sheet")
    (tmp_path / "b.csv").write_bytes(b"y")
    assert file_fingerprints(spark, str(tmp_path)).count() == 2
    before = source_fingerprint(spark, str(tmp_path)).head()["sha256"]
    (tmp_path / "b.csv").write_bytes(b"z")
    assert source_fingerprint(spark, str(tmp_path)).head()["sha256"] != before


def test_query_text_is_not_stored(spark):
    row = sql_fingerprint(spark, "SELECT secret FROM private_table").head()
    assert "private_table" not in str(row) and len(row["sha256"]) == 64


def test_sinks(spark, make, tmp_path):
    df = make("severity string, code string, subject string, value double, threshold double", [
        ("warning", "b", "x", 1.5, 1.0), ("error", "a", "y", None, None)])
    for fmt in ("parquet", "json"):
        write_metrics(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 2
    write_findings(df, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == [
        "- **BLOCKED** a: y", "- **WARN** b: x = 1.5 (limit 1.0)"]


def test_unknown_source(spark):
    with pytest.raises(ValueError, match="not supported"):
        load(spark, "x.pdf")


def test_csv_as_people_have_it(spark, tmp_path):
    awkward = tmp_path / "a.csv"
    awkward.write_text('"name; full","said",amount\n"Acme ""East"", Ltd","he said ""hi, there""",5\n"two\nlines",x,6\n')
    df = read_csv(spark, str(awkward))
    assert df.columns == ["name; full", "said", "amount"]
    assert {tuple(r) for r in df.collect()} == {('Acme "East", Ltd', 'he said "hi, there"', 5), ("two\nlines", "x", 6)}
    plain = tmp_path / "b.csv"
    plain.write_text("1,2.5,2025-01-01\n2,3.5,2025-01-02\n")
    df = read_csv(spark, str(plain))
    assert df.columns == ["column0", "column1", "column2"] and df.count() == 2
    assert read_csv(spark, str(plain), header=True).count() == 1
    times = tmp_path / "c.csv"
    times.write_text("a,b\n2025-01-31 20:00:00,2025-01-31T20:00:00Z\n")
    df = read_csv(spark, str(times))
    assert dict(df.dtypes) == {"a": "timestamp_ntz", "b": "timestamp"} and df.head()["a"].hour == 20


def test_a_later_file_with_more_columns_is_an_error(spark, tmp_path):
    import sqlite3

    for name, columns in (("a.db", "k integer"), ("b.db", "k integer, extra text")):
        con = sqlite3.connect(tmp_path / name)
        con.execute(f"CREATE TABLE t ({columns})")
        con.commit()
        con.close()
    with pytest.raises(Exception, match="extra"):
        read_sqlite(spark, str(tmp_path), "t").collect()


def test_quoted_breaks_after_the_sample(spark, tmp_path):
    plain = "".join(f"{i},n{i}\n" for i in range(700))
    (tmp_path / "late.csv").write_text("id,note\n" + plain + '700,"two\nlines"\n')
    assert read_csv(spark, str(tmp_path / "late.csv")).selectExpr("count(*)", "count(id)", "sum(id)").head()[:] == (701, 701, 245350)
    folder = tmp_path / "files.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("id,note\n" + plain)
    (folder / "b.csv").write_text('id,note\n700,"two\nlines"\n')
    df = read_csv(spark, str(folder))
    assert df.count() == 701 and df.where("id = 700").head()["note"] == "two\nlines"


def split_up(spark, size):
    """Byte ranges of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.mark.parametrize("seed", range(2))
def test_quoted_breaks_are_read_by_many_tasks(spark, tmp_path, seed):
    """Random cells against the standard parser, in byte ranges far smaller than some cells."""
    import csv
    import random

    rng = random.Random(seed)
    parts = ['"', '""', "\n", "a", "é", ",", "\n\n", 'x"y', "long " * 30, "\n" * 40]
    rows = [[str(i), "".join(rng.choice(parts) for _ in range(rng.randrange(6))), rng.choice(["", "z", '5" pipe', 'q\n"q"'])] for i in range(120)]
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for k in range(2):
        with open(folder / f"{k}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\r\n" if seed % 2 else "\n")
            out.writerow(["id", "note\nof", "more"])
            out.writerows(rows[k::2])
    try:
        split_up(spark, "64")
        df = read_csv(spark, str(folder))
        assert df.columns == ["id", "note\nof", "more"] and df.dtypes[0][1] == "int"
        got = {r[0]: (r[1] or "", r[2] or "") for r in df.collect()}
        tasks = spark.read.text(str(folder), lineSep="\n").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 20
    assert got == {int(a): (b, c) for a, b, c in rows}


def test_where_a_line_ends():
    from measureloom.sources.records import ends_inside

    for line, out, inn in [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('5" pipe,"x', True, True),
                           ('"a""', True, False), ('a""b', False, True), ('"a","b', True, True), ("", False, True),
                           ('x",y', False, False), ('x","y', True, True), ('"a"b","c', True, True)]:
        assert (ends_inside(line, False, ","), ends_inside(line, True, ",")) == (out, inn), line


def test_a_quote_inside_a_cell_keeps_the_source_in_lines(spark, tmp_path):
    path = tmp_path / "inch.csv"
    path.write_text('id,what\n1,5" pipe\n2,"a, ""b"""\n')
    df = read_csv(spark, str(path))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, '5" pipe'), (2, 'a, "b"')]
    assert "text" not in df._jdf.queryExecution().toString().lower().split("filescan")[1].split(" ")[1]


def test_types_of_a_text_source(spark, tmp_path):
    path = tmp_path / "types.csv"
    path.write_text("i,l,big,d,day,t,z,b,s,none\n1,5000000000,123456789012345678901,1.5,2025-01-01,2025-01-01 10:00:00,"
                    "2025-01-01T10:00:00Z,true,x,\n-2,3,4,1e3,2025-02-01,2025-01-02,2025-01-01T10:00:00+01:00,False,7,\n")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "decimal(21,0)", "double", "date", "timestamp_ntz", "timestamp", "boolean",
                                         "string", "string"]
    assert df.where("i is null or l is null or big is null or d is null or day is null or t is null or z is null or b is null").count() == 0


def test_long_files_are_hashed_by_many_tasks(spark, tmp_path):
    """The tree digest of ranges, level by level, against plain code."""
    def tree(data, size, fanout):
        level = [hashlib.sha256(data[i:i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
        while len(level) > 1:
            groups = [level[i:i + fanout] for i in range(0, len(level), fanout)]
            level = [g[0] if len(g) == 1 else hashlib.sha256("".join(g).encode()).hexdigest() for g in groups]
        return level[0]

    files = {"empty": b"", "short": b"abc", "even": bytes(range(256)) * 4, "long one": b"x\xff" * 5000 + b"end"}
    folder = tmp_path / "a b"
    folder.mkdir()
    for name, data in files.items():
        (folder / name).write_bytes(data)
    found = file_fingerprints(spark, str(folder), range_bytes=64, fanout=3)
    got = {r["path"].rsplit("/", 1)[-1].replace("%20", " "): (r["bytes"], r["sha256"]) for r in found.collect()}
    files.pop("empty")
    assert got == {n: (len(data), tree(data, 64, 3)) for n, data in files.items()}
    whole = {r["sha256"] for r in file_fingerprints(spark, str(folder)).collect()}
    assert whole == {hashlib.sha256(data).hexdigest() for data in files.values()}
