"""Runs queries and their SQL over one folder and compares rows: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import atexit
import math
import os
import shutil
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        if isinstance(v, bool):
            return v
        if isinstance(v, (list, tuple)):
            return tuple(value(x) for x in v)
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr), sorted(names)


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}"
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    import tempfile

    shared = tempfile.mkdtemp(prefix="talklake-tests-")
    conf = {"spark.checkpoint.dir": f"file://{shared}", "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return spark


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as e

    q, sql, spark, con, bad = e.queries(), e.oracle_sql(), session(), duck(folder), 0
    for n in names or list(q):
        try:
            t = time.time()
            df = q[n](spark, folder)
            got, cols = canonical([tuple(r) for r in df.collect()], df.columns)
            t, t2 = time.time() - t, time.time()
            if n not in sql:
                print(f"{n}: {len(got)} rows, {t:.1f} s, no SQL")
                continue
            cur = con.execute(sql[n])
            names2 = [d[0] for d in cur.description]
            want, cols2 = canonical(cur.fetchall(), names2)
            ok = got == want and cols == cols2
            print(f"{n}: {'ok' if ok else 'DIFFERS'} {len(got)} {len(want)} rows, {t:.1f} s, SQL {time.time() - t2:.1f} s")
            if not ok:
                bad += 1
                a, b = set(map(repr, got)), set(map(repr, want))
                print("  columns", cols, cols2, "\n  only here", sorted(a - b)[:3], "\n  only SQL", sorted(b - a)[:3])
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{n}: FAILED {str(x)[:400]}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
