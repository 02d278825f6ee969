"""Run an operation and its SQL text side by side and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from sievework.sources.tables import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(float(f"{v:.9g}"))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(_cell(r[i])) for i in order) for r in rows)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
         "float": "FLOAT", "smallint": "SMALLINT"}


def differences(df, con, sql: str) -> list[str]:
    """What differs between a DataFrame and an SQL answer; empty when nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    found = [tuple(r) for r in df.collect()]
    problems = []
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} <> {sorted(names)}"]
    for f in df.schema.fields:
        if TYPES.get(f.dataType.simpleString()) != types[f.name]:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} <> {types[f.name]}")
    if len(found) != len(expected):
        problems.append(f"{len(found)} rows <> {len(expected)}")
    a, b = _rows(df.columns, found), _rows(names, expected)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        problems.append(f"rows differ: {[tuple(x[:80] for x in r) for r in only_a]} <> "
                        f"{[tuple(x[:80] for x in r) for r in only_b]}")
    return problems
