"""Run registered queries next to DuckDB on the same parquet files.

    python tests/compare.py [--sf 0.01] [--tiny-slices] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
DATA = Path("/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _kind(series: pd.Series) -> str:
    kind = series.dtype.kind
    return "int" if kind in "iu" else "float" if kind == "f" else "bool" if kind == "b" else "object"


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """A description of the first difference, or None."""
    # integers with missing values are floats in pandas, unless a column of their own kind holds them
    spark_rows, sql_rows = ({c: d[c].astype("float64") if str(d[c].dtype) == "Int64" and d[c].isna().any() else d[c]
                             for c in d.columns} for d in (spark_rows, sql_rows))
    spark_rows, sql_rows = pd.DataFrame(spark_rows), pd.DataFrame(sql_rows)
    left, right = sorted(spark_rows.columns), sorted(sql_rows.columns)
    if left != right:
        return f"columns {left} != {right}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    for c in left:
        if len(spark_rows) and _kind(spark_rows[c]) != _kind(sql_rows[c]):
            return f"type of {c}: {spark_rows[c].dtype} != {sql_rows[c].dtype}"
    a = sorted(tuple(_cell(v) for v in row) for row in spark_rows[left].itertuples(index=False))
    b = sorted(tuple(_cell(v) for v in row) for row in sql_rows[left].itertuples(index=False))
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"values differ in {len(set(a) - set(b))} rows of {left}: {only_a} vs {only_b}"
    return None


def main() -> int:
    from caseloom.catalog import QUERIES, SQL
    from caseloom.session import local_session

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "0.01"
    tiny = "--tiny-slices" in args
    names = [a for a in args if not a.startswith("--") and a != sf] or list(QUERIES)
    folder = str(DATA / f"sf{sf}")
    spark = local_session(8)
    if tiny:
        spark.conf.set("spark.caseloom.sliceRows", "3")
        spark.conf.set("spark.caseloom.hotRows", "3")
        spark.conf.set("spark.caseloom.cellRows", "1000")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, folder).toPandas()
            took = time.time() - start
            if name in SQL:
                problem = difference(got, con.execute(SQL[name]).df())
                status = "ok" if problem is None else f"DIFF {problem}"
            else:
                status = f"rows only ({len(got)})"
        except Exception as error:  # noqa: BLE001
            took, status = time.time() - start, f"ERROR {str(error)[:1500]}"
        bad += status.startswith(("DIFF", "ERROR"))
        print(f"{name:40s} {took:6.2f}s {status}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
