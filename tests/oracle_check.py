"""Compare registered queries with their SQL: python tests/oracle_check.py [folder] [name ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "tinyint": "TINYINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, folder, name):
    """None when equal, else a description of the difference; with both times."""
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got = table(df.columns, df.collect())
    spark_seconds, start = time.time() - start, time.time()
    cursor = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    sql_seconds = time.time() - start
    problem = None
    spark_types = {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema.fields}
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    if spark_types != sql_types:
        problem = f"types {spark_types} / {sql_types}"
    if got != want:
        extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
        problem = (f"columns {got[0]} / {want[0]}, rows {len(got[1])} / {len(want[1])}, "
                   f"only spark {sorted(extra)[:3]}, only sql {sorted(missing)[:3]}")
    return problem, len(got[1]), spark_seconds, sql_seconds


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in names:
        try:
            problem, rows, spark_seconds, sql_seconds = compare(spark, con, folder, name)
        except Exception as error:
            problem, rows, spark_seconds, sql_seconds = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} spark={spark_seconds:.1f}s sql={sql_seconds:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} equal; failed: {failed}")
