"""Run registered queries beside their SQL on DuckDB and report every difference.

    python tests/compare.py [name-pattern] [sf_dir]
"""

from __future__ import annotations

import datetime
import os
import re
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("scoreloom-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def engine(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf_dir):
    start = time.time()
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got), took, ""
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"spark {sorted(df.columns)} sql {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        types = {c: t for c, t in df.dtypes}
        kinds = {d[0]: str(d[1]).lower() for d in cur.description}
        odd = [f"{c}: {types[c]} / {kinds[c]}" for c in types if not same_kind(types[c], kinds[c])]
        return ("same" if got else "EMPTY"), len(got), took, "; ".join(odd)
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return "DIFFERS", len(got), took, f"rows {len(a)} / {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def same_kind(spark_type, sql_type):
    groups = [("int", "bigint", "smallint", "integer", "hugeint"), ("double", "float"), ("string", "varchar"), ("boolean",)]
    for g in groups:
        if spark_type in g:
            return sql_type in g and not (sql_type == "hugeint")
    return True


if __name__ == "__main__":
    import __spark_entry__ as e
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark, con = session(), engine(sf_dir)
    sqls, bad = e.oracle_sql(), []
    for name, build in e.queries().items():
        if not re.search(pattern, name):
            continue
        try:
            status, n, took, note = compare(spark, con, name, build, sqls.get(name), sf_dir)
        except Exception as error:
            status, n, took, note = "ERROR", 0, 0.0, str(error)[:900]
        print(f"{status:10s} {n:8d} {took:6.2f}s {name} {note}", flush=True)
        if status not in ("same", "rows-only"):
            bad.append(name)
    print("not equal:", bad)
