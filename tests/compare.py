"""Run registered queries next to their SQL and compare them value by value.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _kind(series: pd.Series) -> str:
    kind = series.dropna().map(lambda v: type(v).__name__).unique() if series.dtype == object else [series.dtype.kind]
    return {"i": "number", "u": "number", "f": "float", "b": "bool"}.get(kind[0] if len(kind) else "-", str(list(kind)))


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    frame = frame[sorted(frame.columns)]
    out = [tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for c in left.columns:
        a, b = _kind(left[c]), _kind(right[c])
        if a != b and len(left) and not left[c].isna().all():
            return f"type of {c}: {left[c].dtype} {a} != {right[c].dtype} {b}"
    a, b = _rows(left), _rows(right)
    if a == b:
        return ""
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    folder = argv[0] if argv else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    spark, con = session(), database(folder)
    failures = 0
    for name in names:
        begin = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            took = time.time() - begin
            if name in oracles:
                begin = time.time()
                want = con.execute(oracles[name]).df()
                problem = compare(got, want)
                print(f"{'ok  ' if not problem else 'FAIL'} {name} rows={len(got)} spark={took:.2f}s sql={time.time() - begin:.2f}s {problem}"[:900], flush=True)
                failures += bool(problem)
            else:
                print(f"rows {name} rows={len(got)} spark={took:.2f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            failures += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:700]}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
