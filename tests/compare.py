"""Run every catalogue query against its SQL counterpart and report differences."""

import argparse
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tabprobe.session import build_session  # noqa: E402

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    rows = [
        tuple(
            None if v is None else (float(v) if isinstance(v, float) else v) for v in row
        )
        for row in df.itertuples(index=False, name=None)
    ]
    return sorted(rows, key=repr)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    types = [
        (c, str(spark_df[c].dtype), str(sql_df[c].dtype))
        for c in spark_df.columns
        if spark_df[c].dtype.kind != sql_df[c].dtype.kind and "O" not in spark_df[c].dtype.kind + sql_df[c].dtype.kind
        # pandas holds whole numbers with nulls either as floats or in a type of their own
        and not (spark_df[c].dtype.kind == "f" and str(sql_df[c].dtype) == "Int64" and spark_df[c].isna().any())
    ]
    left, right = canonical(spark_df), canonical(sql_df)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} rows differ, first: {bad[0]}"
    return f"types {types}" if types else None


if __name__ == "__main__":
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = []
    for name, query in entry.queries().items():
        if args.names and name not in args.names:
            continue
        try:
            start = time.time()
            got = query(spark, args.sf).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            start = time.time()
            problem = None if sql is None else differences(got, con.execute(sql).df())
            print(f"{'ok  ' if not problem else 'DIFF'} {name:26} {len(got):8} rows {took:6.2f}s sql {time.time()-start:6.2f}s {problem or ''}"[:1500], flush=True)
        except Exception as error:
            problem = str(error)[:1500]
            print(f"FAIL {name} {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    spark.stop()
