"""Run the queries against their SQL: ``python -m checks.compare SF_DIR [NAME ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = ["nation", "customer", "part", "orders", "lineitem", "events", "embeddings"]


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def oracle_frame(con, name: str) -> pd.DataFrame:
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    return pd.DataFrame(cursor.fetchall(), columns=columns)


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (int, np.integer)):
        return repr(int(value))
    return str(value)


def canonical(rows: list, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def difference(spark, con, sf: str, name: str) -> str | None:
    """None when the query and its SQL agree exactly, else a short description."""
    df = QUERIES[name](spark, sf)
    ours = canonical([tuple(row) for row in df.collect()], df.columns)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    off = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(off)} of {len(ours)} rows differ, first {off[0]}" if off else None


def main() -> None:
    from tillroll.session import local_session

    sf, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, con, sf, name)
                verdict = problem or "equal"
            else:
                problem, rows = None, QUERIES[name](spark, sf).count()
                verdict = f"{rows} rows" if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = verdict = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:7.2f}s  {verdict}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
