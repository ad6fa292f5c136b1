"""Run registered queries on Spark and their SQL on DuckDB; compare results.

    python tests/oracle_compare.py [sf_dir] [query ...]

Compares column names, row count and the multiset of rows (values
normalised to text; order-insensitive). Prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()[:10] if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, x or "") for x in t))


def compare(spark, sf_dir: str, names=None, con=None, verbose=False):
    from __spark_entry__ import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = con or duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            s_cols = sdf.columns
            s_rows = [tuple(r) for r in sdf.collect()]
            t1 = time.time()
            if name not in sqls:
                results[name] = ("rows-only", len(s_rows), round(t1 - t0, 2), "")
                continue
            con.execute(f"CREATE OR REPLACE VIEW checked AS {sqls[name]}")      # a statement has to fit in a view
            rel = con.execute("SELECT * FROM checked")
            d_cols = [d[0] for d in rel.description]
            d_rows = rel.fetchall()
            sc, sr = rows_of(s_cols, s_rows)
            dc, dr = rows_of(d_cols, d_rows)
            if sc != dc:
                status, note = "COLS", f"spark={sc} duck={dc}"
            elif len(sr) != len(dr):
                status, note = "COUNT", f"spark={len(sr)} duck={len(dr)}"
            elif sr != dr:
                diff = [(a, b) for a, b in zip(sr, dr) if a != b][:2]
                status, note = "VALUES", f"{diff}"
            else:
                status, note = "OK", ""
            results[name] = (status, len(s_rows), round(t1 - t0, 2), note)
        except Exception as exc:  # report and go on
            results[name] = ("ERROR", 0, round(time.time() - t0, 2), repr(exc)[:400])
        if verbose:
            status, n, sec, note = results[name]
            print(f"{status:8s} {name:28s} rows={n:<7d} {sec:6.2f}s {note}", flush=True)
    return results


def main(argv):
    from staylens.session import get_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or None
    spark = get_session("local[8]", 8)
    res = compare(spark, sf_dir, names, verbose=True)
    ok = sum(r[0] == "OK" for r in res.values())
    print(f"{ok}/{len(res)} OK")


if __name__ == "__main__":
    main(sys.argv)
