"""Run queries beside their SQL on the same parquet files and compare the rows.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(v)
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(c) or "" for c in row) for row in frame[columns].astype(object).itertuples(index=False, name=None))


def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} vs {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    for c in mine.columns:
        a, b = mine[c].dtype, theirs[c].dtype
        if a != b and not mine[c].isna().any():
            return f"type of {c}: {a} vs {b}"
    left, right = normal(mine), normal(theirs)
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} vs {b} of {sorted(mine.columns)}"
    return ""


def main() -> None:
    from tests.conftest import make_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        start = time.time()
        try:
            mine = queries[name](spark, sf_dir).toPandas()
            seconds = time.time() - start
            if name in oracles:
                verdict = compare(mine, con.execute(oracles[name]).df())
                mark = "ok" if not verdict else "DIFF"
            else:
                verdict, mark = "", "rows"
        except Exception as error:  # noqa: BLE001 - report and go on with the other queries
            mine, seconds, verdict, mark = [], time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", "FAIL"
        bad += mark in ("DIFF", "FAIL")
        print(f"{mark:5} {name:28} {len(mine):8} rows {seconds:6.1f}s {verdict}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
