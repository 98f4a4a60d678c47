"""Run registered queries on Spark and their SQL oracles on DuckDB, and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
Comparison: same column names, same row count, and equal multisets of rows
after rounding doubles to 9 significant digits.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v if os.environ.get("ORACLE_EXACT") else float(f"{v:.9g}")
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name, q, sql, sf_dir):
    t0 = time.time()
    sdf = q(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(scols) == sorted(dcols)
    tmap = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
            "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}
    stypes = {f.name: tmap.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in res.description} if False else None
    try:
        dtypes = dict(con.execute(f"DESCRIBE ({sql})").fetchall() and
                      [(r[0], r[1]) for r in con.execute(f"DESCRIBE ({sql})").fetchall()])
    except Exception:
        dtypes = {}
    tdiff = {c: (stypes.get(c), dtypes.get(c)) for c in stypes if dtypes and stypes.get(c) != dtypes.get(c)}
    if tdiff:
        print(f"TYPE {name:28} {tdiff}")
    ok_n = len(srows) == len(drows)
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    ok_v = ok_cols and a == b
    status = "OK" if (ok_cols and ok_n and ok_v) else "FAIL"
    print(f"{status:4} {name:28} rows={len(srows)}/{len(drows)} spark={t1 - t0:.1f}s duck={t2 - t1:.1f}s",
          flush=True)
    if status == "FAIL":
        if not ok_cols:
            print("   cols spark", sorted(scols), "\n   cols duck ", sorted(dcols))
        else:
            diff_a = [r for r in a if r not in b][:3]
            diff_b = [r for r in b if r not in a][:3]
            print("   spark-only", diff_a, "\n   duck-only ", diff_b)
    return status == "OK"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from textcontrols.session import get_spark, checkpoint_dir

    if os.environ.get("PLAIN_SESSION"):  # as a driver would build it: no library defaults
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    else:
        spark = get_spark(master="local[8]", shuffle_partitions=8, conf={"spark.driver.memory": "8g"})
        checkpoint_dir(spark)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = []
    for name in names or list(qs):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            print(f"ROWS {name:28} rows={df.count()} (no SQL oracle)", flush=True)
            continue
        try:
            if not compare(spark, con, name, qs[name], sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # report and continue
            print(f"ERR  {name:28} {type(e).__name__}: {str(e)[:400]}", flush=True)
            bad.append(name)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
