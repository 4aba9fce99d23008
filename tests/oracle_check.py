"""Run registered queries and their SQL side by side: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "\x00"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v)) if v != int(v) else str(int(v))
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(" ")
    return str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, sf, name, build, sql):
    start = time.time()
    df = build(spark, sf)
    got_cols, got = sorted_rows(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return "rows", len(got), took, ""
    start = time.time()
    cur = con.execute(sql)
    want_cols, want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    duck = time.time() - start
    note = f"duckdb {duck:.2f}s"
    if got_cols != want_cols:
        return "COLUMNS", len(got), took, f"{got_cols} / {want_cols}"
    if got == want:
        return "match", len(got), took, note
    a, b = set(got) - set(want), set(want) - set(got)
    return "DIFF", len(got), took, f"{len(want)} wanted; only spark {len(a)} {sorted(a)[:2]}; only sql {len(b)} {sorted(b)[:2]}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tesora.session import build_session

    size = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf = f"/root/testdata/sf{size}"
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": os.environ.get("PARTS", "8"), "spark.ui.enabled": "false",
                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), oracle_sql(), 0
    for name, build in queries().items():
        if wanted and not any(w == name or w in name and w not in oracles for w in wanted):
            continue
        try:
            state, n, took, note = compare(spark, con, sf, name, build, oracles.get(name))
        except Exception as exc:  # report and go on
            state, n, took, note = "ERROR", -1, 0.0, f"{type(exc).__name__}: {str(exc)[:600]}"
            if wanted:
                traceback.print_exc()
        bad += state not in ("match", "rows")
        print(f"{state:8} {name:28} rows={n:<7} {took:6.2f}s {note[:900]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
