"""Runs a registered query and its SQL oracle and compares rows by value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.6f}")
    if type(value).__name__ == "Decimal":
        return float(value)
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> str:
    """Empty if both sides agree."""
    got = con.execute(sql)
    oracle_names = [d[0] for d in got.description]
    oracle = _rows(oracle_names, got.fetchall())
    if sorted(oracle_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(oracle_names)}"
    ours = _rows(spark_df.columns, spark_df.collect())
    if ours == oracle:
        return ""
    only_ours, only_oracle = ours - oracle, oracle - ours
    return (
        f"{sum(ours.values())} rows against {sum(oracle.values())}; "
        f"{sum(only_ours.values())} only in Spark, e.g. {sorted(only_ours, key=str)[:2]}; "
        f"{sum(only_oracle.values())} only in SQL, e.g. {sorted(only_oracle, key=str)[:2]}"
    )
