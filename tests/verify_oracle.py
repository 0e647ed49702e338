"""Compare queries() with oracle_sql() on one data folder: python tests/verify_oracle.py [DIR] [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings project_subfolders courts chat_messages feed_passage_hits audit_log tabular_cells size_limits".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple("\\N" if not hasattr(v, "__len__") and pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return sorted(out)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} against {sorted(theirs.columns)}"
    a, b = rows_of(mine), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not diff else f"{len(diff)} of {len(a)} rows differ: {diff[:2]}"


if __name__ == "__main__":
    import __spark_entry__ as e

    from docketspark.session import build_session, release

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = build_session(), connect(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or list(q):
        t = time.time()
        try:
            if name in o:
                said = compare(spark, con, name, q[name], o[name], sf_dir)
                said = said or "ok"
            else:
                said = f"{q[name](spark, sf_dir).count()} rows (no SQL)"
        except Exception as x:
            said = f"error {type(x).__name__}: {str(x)[:600]}"
        bad += said != "ok" and "no SQL" not in said
        release()
        print(f"{name}: {said} [{time.time() - t:.1f} s]", flush=True)
    print("BAD", bad)
