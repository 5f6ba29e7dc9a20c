"""Compare registered queries with their SQL on DuckDB: ``python tools/check.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from jobscope.bindings import BASE_TABLES  # noqa: E402
from jobscope.entries import ORACLES, QUERIES  # noqa: E402
from jobscope.session import build_session  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in BASE_TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    text = frame[columns].astype(object).where(frame[columns].notna(), None).map(lambda v: None if v is None else str(v))
    return sorted(map(tuple, text.itertuples(index=False, name=None)), key=repr)


def types_of(schema) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def compare(spark, con, sf_dir: str, name: str) -> str:
    """Empty text when equal, otherwise what differs."""
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLES:
        return "" if got.num_rows else "no rows"
    want = con.sql(ORACLES[name]).to_arrow_table()
    if types_of(got.schema) != types_of(want.schema):
        return f"schema: spark {types_of(got.schema)} sql {types_of(want.schema)}"
    a, b = rows_of(got.to_pandas()), rows_of(want.to_pandas())
    if len(a) != len(b):
        extra = sorted(set(a) - set(b), key=repr)[:2], sorted(set(b) - set(a), key=repr)[:2]
        return f"rows: spark {len(a)} sql {len(b)}; {extra}"
    for x, y in zip(a, b):
        if x != y:
            return f"values: spark {x} sql {y}"
    return "" if a else "both empty"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in args or list(QUERIES):
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{bad} failed of {len(args or QUERIES)}; {len(set(QUERIES) - set(ORACLES))} without SQL")
    return bad


if __name__ == "__main__":
    sys.exit(main())
