"""Compare registered queries with their SQL oracles: `python tests/check.py [sf] [name ...]`."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])  # for Python workers, from whatever folder this runs

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session(**conf):
    from pyspark.sql import SparkSession

    b = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
         .config("spark.sql.session.timeZone", "UTC"))
    for k, val in conf.items():
        b = b.config(k, val)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if hasattr(x, "as_tuple"):
        x = float(x)
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(norm(i) for i in x)
    return x


def key(row):
    return tuple((x is None, str(type(x)), x if not isinstance(x, bool) else int(x)) if x is not None else (True, "", 0)
                 for x in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(norm(x) for x in r) for r in df.select(*cols).collect()], key=str)


def duck_rows(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = con.fetchall()
    return [names[i] for i in order], sorted([tuple(norm(r[i]) for i in order) for r in rows], key=str)


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    cols, got = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(got)} rows (no oracle) {t1 - t0:.1f}s"
    ocols, want = duck_rows(con, sql)
    if cols != ocols:
        return False, f"{name}: columns {cols} != {ocols}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return False, f"{name}: {len(got)} vs {len(want)} rows; cols {cols}; first differences {bad}"
    return True, f"{name}: {len(got)} rows {t1 - t0:.1f}s (oracle {time.time() - t1:.1f}s)"


def main(argv):
    import __spark_entry__ as e

    conf = {}
    if argv and argv[0] == "--tiny":  # force every ordered group into slices
        conf["spark.callmeter.group.maxRows"] = "50"
        argv = argv[1:]
    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(**conf), duck(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for n in names:
        try:
            ok, text = compare(spark, con, sf_dir, n, queries[n], oracle.get(n))
        except Exception as ex:  # noqa: BLE001
            ok, text = False, f"{n}: {type(ex).__name__} {str(ex)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print(f"{len(names) - bad} of {len(names)} ok; oracles without a query: {sorted(set(oracle) - set(queries))}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
