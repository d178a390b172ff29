"""Run registered queries beside their checking SQL and compare the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted([norm(r[i]) for i in order] for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the first difference."""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    scols = df.columns
    if sorted(dcols) != sorted(scols):
        return f"columns {sorted(scols)} != {sorted(dcols)}"
    _, a = rows_of(scols, [tuple(r) for r in df.collect()])
    names, b = rows_of(dcols, drows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(n, p[:80], q[:80]) for n, p, q in zip(names, x, y) if p != q]
        return f"{len(bad)} of {len(a)} rows differ, first: {diff[:4]}"
    return None


def main(argv):
    from featlake.plans import ORACLES, QUERIES
    from featlake.session import build_session

    sf = argv[0]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "20g", "spark.checkpoint.dir": "/tmp/checkpoints"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    fails = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLES:
                msg = compare(df, con, ORACLES[n])
            else:
                msg = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:600]}"
        fails += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {n} {time.time() - t:.1f}s {'' if n in ORACLES else '(rows only)'} {msg or ''}", flush=True)
    print(f"{len(names)} queries, {fails} failed", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
