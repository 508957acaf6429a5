"""Comparison of a Spark result with its SQL, as multisets of rows."""

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of_spark(frame) -> tuple[list[str], Counter]:
    names = sorted(frame.columns)
    return names, Counter(tuple(_plain(row[n]) for n in names) for row in frame.select(*names).collect())


def rows_of_sql(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    index = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(row[i]) for i in index) for row in result.fetchall())


def differences(frame, con, sql: str) -> str:
    """Empty if equal, otherwise a short account of the difference."""
    spark_names, spark_rows = rows_of_spark(frame)
    sql_names, sql_rows = rows_of_sql(con, sql)
    if spark_names != sql_names:
        return f"columns {spark_names} <> {sql_names}"
    if spark_rows != sql_rows:
        extra, missing = spark_rows - sql_rows, sql_rows - spark_rows
        return (f"{sum(spark_rows.values())} rows <> {sum(sql_rows.values())}; {spark_names}; "
                f"only Spark {sum(extra.values())}: {list(extra)[:2]}; only SQL {sum(missing.values())}: {list(missing)[:2]}")
    return ""
