"""Run queries against their SQL on one data folder and report differences.

Usage: python tests/check_queries.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype) == "Int64":  # whole numbers with nulls; Spark's come as floats
            pdf[c] = pdf[c].astype("float64")
        if pdf[c].dtype == object or str(pdf[c].dtype) in ("string", "str"):
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA else str(v))
    return pdf.sort_values(list(pdf.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        if str(a[c].dtype) != str(b[c].dtype) and {a[c].dtype.kind, b[c].dtype.kind} != {"O"}:
            if not (a[c].dtype.kind in "OTUS" and b[c].dtype.kind in "OTUS"):
                return f"type of {c}: {a[c].dtype} != {b[c].dtype}"
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c}, e.g. {a[c][i]!r} != {b[c][i]!r}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from quietroom.session import local_session

    args = sys.argv[1:]
    folder = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.conf.set("quietroom.textPartitions", "8")
    con = connect(folder)
    oracles, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if len(args) > 1 and name not in args[1:]:
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            start = time.time()
            problem = "" if name in oracles else f"no SQL, {len(got)} rows"
            if name in oracles:
                problem = difference(got, con.execute(oracles[name]).df()) or f"ok, {len(got)} rows"
            sql_took = time.time() - start
        except Exception as error:  # report and go on with the other queries
            took, sql_took, problem = time.time() - start, 0, f"ERROR {str(error)[:1500]}"
        failed += not problem.startswith(("ok", "no SQL"))
        print(f"{name:24s} {took:7.2f}s {sql_took:6.2f}s  {problem}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
