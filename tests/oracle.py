"""Run a registered query and its SQL twin and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not mine and not theirs:
        return None
    if mine != theirs:
        left = [r for r in mine if r not in set(theirs)]
        right = [r for r in theirs if r not in set(mine)]
        return f"rows {len(mine)} vs {len(theirs)}; only here {left[:3]}; only there {right[:3]}"
    return None


_SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE",
    "timestamp": "TIMESTAMP",
}


def type_differences(df, con, sql) -> list[str]:
    """Columns whose types are not each other's counterpart."""
    theirs = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return [
        f"{name}: {kind} / {theirs[name]}"
        for name, kind in df.dtypes
        if name in theirs and _SAME.get(kind) != theirs[name]
    ]
