"""Compare a Spark result with DuckDB's answer to the query's SQL."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Type families that hold the same values; any other pairing is reported as a difference.
_SPARK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str, kind: str = "VIEW") -> duckdb.DuckDBPyConnection:
    """The given tables as views, or loaded as tables: some SQL binds on one of them only."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE {kind} {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float) and v != v:
        return "NaN"
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def difference(df, con, sql: str) -> str | None:
    """None when rows, column names and types agree, else what differs."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if names != sorted(rel.columns):
        return f"columns {names} vs {sorted(rel.columns)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for n in names:
        if _SPARK.get(spark_types[n], spark_types[n]) != duck_types[n]:
            return f"type of {n}: {spark_types[n]} vs {duck_types[n]}"
    got = Counter(tuple(_value(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    want = Counter(tuple(_value(r[i]) for i in at) for r in rel.fetchall())
    if not want:
        return "the SQL gives no rows: nothing is tested"
    if got != want:
        only, missing = got - want, want - got
        return (
            f"{sum(got.values())} vs {sum(want.values())} rows; "
            f"only Spark {list(only.items())[:3]}; only SQL {list(missing.items())[:3]}"
        )
    return None
