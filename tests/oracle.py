"""Compare registered queries with their SQL: names, row counts and values."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
                out.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, float) or type(v).__name__.startswith("float"):
                out.append(repr(float(v)))
            elif type(v).__name__.startswith(("int", "uint")):
                out.append(str(int(v)))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    got = queries()[name](spark, sf_dir).toPandas()
    if name not in oracle_sql():
        return None if len(got) else "no rows"
    want = con.execute(oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from recordlens.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in queries():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as exc:  # report and go on
            result = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
