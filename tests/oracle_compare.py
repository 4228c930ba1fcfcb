"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Prints one line per query: rows, schema and order-insensitive value match.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v if isinstance(v, str) else str(v)


def table_hash(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con, verbose=True):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    if sql is None:
        return dict(name=name, rows=len(s_rows), oracle=False, spark_s=round(t1 - t0, 2))
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = [tuple(r) for r in rel.fetchall()]
    t2 = time.time()
    sh, sl = table_hash(s_cols, s_rows)
    dh, dl = table_hash(d_cols, d_rows)
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows),
               schema=sorted(c.lower() for c in s_cols) == sorted(c.lower() for c in d_cols),
               values=sh == dh, spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2))
    if verbose and not (res["values"] and res["schema"]):
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        a, b = set(sl), set(dl)
        res["only_spark"] = sorted(a - b)[:3]
        res["only_duck"] = sorted(b - a)[:3]
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from intentspark.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        try:
            r = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=name, error=f"{type(e).__name__}: {str(e)[:400]}")
        ok = r.get("values", True) and r.get("schema", True) and "error" not in r
        bad += not ok
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
