"""Run registered queries on Spark and their SQL on DuckDB and compare.

    python tools/compare.py <sf_dir> [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from counterfold.plans.catalog import all_queries  # noqa: E402
from counterfold.session import local_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def differences(spark_df, con, sql: str) -> str | None:
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} vs {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for c in left:
        if right[c].dtype == "Int64" and left[c].dtype.kind == "f":  # whole numbers with nulls
            left[c] = left[c].astype("Int64")
    kinds = [(c, left[c].dtype.kind, right[c].dtype.kind) for c in left if left[c].dtype.kind != right[c].dtype.kind]
    a, b = canonical(left), canonical(right)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]} (columns {sorted(left.columns)}) kinds {kinds}"
    if kinds:
        return f"types {kinds}"
    return None


def main() -> int:
    sf_dir, parts = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    failed = []
    for name, q in all_queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            frame = q.run(spark, sf_dir)
            problem = differences(frame, con, q.sql) if q.sql else (None if frame.count() else "no rows")
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if q.sql else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
