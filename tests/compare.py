"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _order(row):
    return tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in row)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    rows = [tuple(_plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    return names, sorted(rows, key=_order)


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_difference(df, con, text: str) -> str | None:
    mine = {name: SQL_TYPES.get(kind, kind) for name, kind in df.dtypes}
    theirs = {d[0]: str(d[1]) for d in con.execute(text).description}
    off = {n: (mine[n], theirs.get(n)) for n in mine if mine[n] != theirs.get(n)}
    return f"types {off}" if off else None


def rows_of_duck(con, text: str) -> tuple[list[str], list[tuple]]:
    res = con.execute(text)
    order = sorted(range(len(res.description)), key=lambda k: res.description[k][0])
    names = [res.description[k][0] for k in order]
    rows = [tuple(_plain(r[k]) for k in order) for r in res.fetchall()]
    return names, sorted(rows, key=_order)


def difference(df, con, text: str) -> str | None:
    """None if names, types and rows agree, else what differs first."""
    names, mine = rows_of_spark(df)
    theirs_names, theirs = rows_of_duck(con, text)
    if names != theirs_names:
        return f"columns {names} != {theirs_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return type_difference(df, con, text)
