"""Run named queries on Spark and their SQL counterparts on DuckDB and compare."""

import math
from pathlib import Path

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else float(f"{value:.12g}")
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(shaped, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf_dir, query, sql):
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(set(names) ^ set(df.columns))}"
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, found.fetchall())
    if len(ours) != len(theirs):
        return f"rows: {len(ours)} against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
