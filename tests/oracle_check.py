"""Compare registered queries with their SQL, column by column."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype) == "Int64":
            df[c] = df[c].astype("float64")
        elif str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
        elif df[c].dtype == object and df[c].notna().any():
            df[c] = df[c].map(lambda v: None if v is None else str(v))
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def differences(spark, con, sf_dir: str, name: str) -> tuple[int, list[str]]:
    """Number of rows, and what differs between the query and its SQL."""
    from energylake.plans.oracle import ORACLE
    from energylake.plans.queries import QUERIES

    got = _canonical(QUERIES[name](spark, sf_dir).toPandas())
    want = _canonical(con.execute(ORACLE[name]).df())
    if list(got.columns) != list(want.columns):
        return len(got), [f"columns {list(got.columns)} != {list(want.columns)}"]
    if len(got) != len(want):
        return len(got), [f"rows {len(got)} != {len(want)}"]
    found = []
    for c in got.columns:
        if got[c].dtype.kind != want[c].dtype.kind:
            found.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = int((~same).idxmax())
            found.append(f"{c}: {(~same).sum()} differ, {got[c][i]!r} != {want[c][i]!r}")
    return len(got), found


if __name__ == "__main__":
    from energylake.plans.oracle import ORACLE
    from energylake.session import local_session

    session = local_session(8)
    folder = f"/root/testdata/sf{sys.argv[1]}"
    connection = connect(folder)
    bad = 0
    for query in sys.argv[2:] or list(ORACLE):
        begun = time.time()
        try:
            rows, found = differences(session, connection, folder, query)
        except Exception as error:
            rows, found = -1, [f"{type(error).__name__}: {str(error)[:400]}"]
        bad += bool(found)
        print(f"{query:26s}{rows:9d}{time.time() - begun:7.1f}s", found or "ok", flush=True)
    print("bad:", bad)
