"""Run catalogue queries next to their SQL and compare whole results."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value if value is None else str(value)


def spark_rows(df) -> tuple[list[str], list[str], list[tuple]]:
    cols = sorted(df.columns)
    types = [t.simpleString() for t in (df.schema[c].dataType for c in cols)]
    rows = [tuple(normal(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, types, sorted(rows, key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[str], list[tuple]]:
    cur = con.execute(f"SELECT * FROM ({sql})")
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    types = [str(cur.description[i][1]) for i in order]
    rows = [tuple(normal(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], types, sorted(rows, key=repr)


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def differences(df, con, sql: str) -> list[str]:
    cols, types, got = spark_rows(df)
    names, duck_types, want = duck_rows(con, sql)
    out = []
    if cols != names:
        out.append(f"columns {cols} != {names}")
    for c, a, b in zip(cols, types, duck_types):
        if SAME_TYPE.get(a) != b:
            out.append(f"type of {c}: {a} != {b}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        out.append(f"values differ, first: {bad}")
    return out
