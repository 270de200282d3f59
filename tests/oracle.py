"""Runs queries beside their SQL in DuckDB and compares rows as multisets."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.12g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return v
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    if sql is None:
        return True, f"{name}: {len(got)} rows (no SQL) {spent:.1f}s"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"{name}: columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
    if a == b:
        return True, f"{name}: ok {len(got)} rows {spent:.1f}s"
    return False, (f"{name}: {len(got)} vs {len(want)} rows, {spent:.1f}s\n   columns {sorted(cols)}\n   only spark {list((a - b).items())[:4]}\n"
                   f"   only sql   {list((b - a).items())[:4]}")


def main(sf_dir, names):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    from pricewell.session import get_spark

    spark = get_spark(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for n in names or qs:
        try:
            ok, msg = compare(spark, con, n, qs[n], os_.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{n}: {type(e).__name__} {str(e)[:700]}"
        bad += not ok
        print(("" if ok else "FAIL ") + msg, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
