"""Holds a Spark result against DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def difference(df, con, sql):
    """None if both have the same columns and rows, order aside; else what differs."""
    ours, theirs = df.toPandas(), con.sql(sql).df()
    columns = sorted(ours.columns)
    if columns != sorted(theirs.columns):
        return f"columns {columns} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    cell = lambda v: "null" if pd.isna(v) else f"{v + 0.0:.6f}" if isinstance(v, float) and v % 1 else str(int(v)) if isinstance(v, float) else str(v)
    a, b = (sorted(map(tuple, f[columns].astype(object).map(cell).values.tolist())) for f in (ours, theirs))
    return next((f"{columns}: {x} and {y}" for x, y in zip(a, b, strict=True) if x != y), None)
