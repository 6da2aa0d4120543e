"""Compare catalog queries with their SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value if isinstance(value, int) else str(value)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, query, sql) -> str | None:
    df = query(spark, sf_dir)
    names, got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    wanted_names, wanted = as_rows([c[0] for c in cursor.description], cursor.fetchall())
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if got == wanted:
        return None if got else "EMPTY"
    extra = [r for r in got if r not in wanted][:3]
    lacking = [r for r in wanted if r not in got][:3]
    return f"rows {len(got)} vs {len(wanted)}; spark only {extra}; sql only {lacking}"


def main():
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from measureloom.session import local_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        kind = "" if name in oracles else " (rows only)"
        note = "ok" if problem is None else problem
        bad += problem is not None and problem != "EMPTY"
        print(f"{name}{kind} {time.time() - start:.2f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
