"""Run registered queries beside their SQL: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    text = df.map(lambda v: "null" if v is None or v is pd.NaT or v != v else repr(v.item() if hasattr(v, "item") else v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    """Empty when both tables hold the same rows under the same names."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    a, b = canonical(ours), canonical(theirs)
    if a.equals(b):
        return ""
    bad = (a != b).any(axis=1)
    return f"{bad.sum()} of {len(a)} rows differ\n{a[bad].head(3)}\n{b[bad].head(3)}\n{ours.dtypes.to_dict()} {theirs.dtypes.to_dict()}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from shardwise.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql, bad = database(sf_dir), entry.queries(), entry.oracle_sql(), 0
    for name in sys.argv[2:] or queries:
        begin = time.time()
        try:
            ours = queries[name](spark, sf_dir).toPandas()
            spent = time.time() - begin
            theirs = con.sql(sql[name]).df() if name in sql else None
            verdict = "rows only" if theirs is None else difference(ours, theirs)
        except Exception as error:
            spent, verdict, ours = time.time() - begin, f"error: {str(error)[:600]}", []
        bad += verdict not in ("", "rows only")
        print(f"{name:24s} {spent:6.2f}s {time.time() - begin - spent:6.2f}s {len(ours):7d} rows  {verdict or 'ok'}", flush=True)
    print("different:", bad, "without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
