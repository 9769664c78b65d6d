"""Run registered queries against their SQL twins: `check_twins.py FOLDER [NAME ...]`.

Columns are sorted by name and rows by value; doubles are compared at 9 significant digits.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from boutwise.catalog import ORACLES, QUERIES
from boutwise.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return f"{v + 0.0:.9g}" if v == v else "nan"
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, folder):
    start = time.time()
    df = QUERIES[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} rows", took, 0.0
    start = time.time()
    rel = con.sql(ORACLES[name])
    want = rel.fetchall()
    took_sql = time.time() - start
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(list(rel.columns), want)
    types = {c: (t, str(rel.types[list(rel.columns).index(c)])) for c, t in df.dtypes if c in rel.columns}
    odd = {c: t for c, t in types.items() if t not in SAME}
    note = f" types {odd}" if odd else ""
    if gc != wc:
        return f"COLUMNS {set(gc) ^ set(wc)}", took, took_sql
    if gr != wr:
        bad = [(g, w) for g, w in zip(gr, wr) if g != w][:2]
        cols = [c for i, c in enumerate(gc) if bad and bad[0][0][i] != bad[0][1][i]]
        return f"DIFFERS {len(gr)} vs {len(wr)} in {cols}\n   {gc}\n   {bad}{note}", took, took_sql
    return f"ok {len(gr)} rows{note}", took, took_sql


SAME = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("date", "DATE"),
        ("boolean", "BOOLEAN"), ("timestamp_ntz", "TIMESTAMP")}


def main():
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = 0
    for name in [n for n in QUERIES if not names or any(n.startswith(p) for p in names)]:
        try:
            verdict, took, took_sql = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            verdict, took, took_sql = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0
        failed += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:34s} {took:6.1f}s {took_sql:6.1f}s {verdict}", flush=True)
    print(f"failed {failed}")


if __name__ == "__main__":
    main()
