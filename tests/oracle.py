"""Compare queries with their DuckDB SQL: python tests/oracle.py [NAME...]; used by the tests too."""

import glob
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + ":" + os.environ.get("PYTHONPATH", "")


def rows(names, data):
    out = []
    order = sorted(range(len(names)), key=lambda i: names[i])
    for r in data:
        out.append(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order))
    return sorted(names), sorted(out)


def compare(spark, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {name} AS FROM '{src}'")
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        raise AssertionError((len(got[1]), len(want[1]), sorted(a - b)[:3], sorted(b - a)[:3]))
    return len(got[1])


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    q, o = E.queries(), E.oracle_sql()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    for n in sys.argv[1:] or q:
        t = time.time()
        try:
            k = compare(s, q[n], o[n], sf) if n in o else q[n](s, sf).count()
            print("ok  ", n, k, "" if n in o else "rows only", round(time.time() - t, 1), flush=True)
        except Exception as e:
            print("FAIL", n, str(e)[:700], flush=True)
