"""Run a registered query on Spark and its SQL on DuckDB, and compare all rows."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf) / (t + '.parquet')}')")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(_norm(x) for x in v.values())
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    return str(v) if not isinstance(v, str) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


def check(name, spark, sf, con, queries, sqls):
    t = time.time()
    cols, got = spark_rows(queries[name](spark, sf))
    spent = time.time() - t
    if name not in sqls:
        return f"rows-only {len(got)}", spent, len(got) > 0
    t = time.time()
    dcols, want = duck_rows(con, sqls[name])
    duck = time.time() - t
    if cols != dcols:
        return f"columns differ: {cols} / {dcols}", spent, False
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        miss = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} / {len(want)}; spark only {extra}; sql only {miss}", spent, False
    return f"ok {len(got)} rows (duckdb {duck:.2f}s)", spent, len(got) > 0
