"""Run queries in Spark and their SQL in DuckDB; report differences."""

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else float(v))
    if isinstance(v, int):
        return repr(float(v)) if False else str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir, queries, sql):
    t = time.time()
    df = queries[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if name not in sql:
        return took, len(ours[1]), None
    t = time.time()
    cur = con.execute(sql[name])
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    duck = time.time() - t
    if ours[0] != theirs[0]:
        return took, len(ours[1]), f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return took, len(ours[1]), f"rows {len(ours[1])} vs {len(theirs[1])} ({duck:.1f}s)\n   spark {sorted(a - b)[:2]}\n   duck  {sorted(b - a)[:2]}"
    return took, len(ours[1]), ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="netloom-compare-"))
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(e.queries())
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            took, n, err = compare(spark, con, name, sf_dir, e.queries(), e.oracle_sql())
        except Exception as exc:  # noqa: BLE001
            took, n, err = 0, 0, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(err)
        print(f"{'FAIL' if err else 'ok  ' if err == '' else 'rows'} {name} {n} rows {took:.1f}s {err or ''}", flush=True)
    print("failures:", bad)
