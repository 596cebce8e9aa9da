"""Compare a Spark result with the SQL result as bags of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = bag(names, rel.fetchall())
    got = bag(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"
    if got == want:
        return None
    extra, lost = got - want, want - got
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; {sum(extra.values())} unexpected, e.g. "
        f"{list(extra)[:2]}, {sum(lost.values())} missing, e.g. {list(lost)[:2]}"
    )
