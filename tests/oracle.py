"""Runs a query on Spark and its statement on DuckDB, and compares the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return value if isinstance(value, (int, bool, type(None))) else str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda at: names[at])
    return [names[at] for at in order], Counter(tuple(_plain(row[at]) for at in order) for row in rows)


def compare(spark, con, folder: str, query, sql: str) -> str | None:
    """None if both agree, else what differs."""
    frame = query(spark, folder)
    got = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    done = con.execute(sql)
    want = rows_of([column[0] for column in done.description], done.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if got[1] != want[1]:
        extra, missing = got[1] - want[1], want[1] - got[1]
        head = f"{got[1].total()} rows instead of {want[1].total()}; {extra.total()} differ"
        return f"{head}\n   spark  {sorted(map(str, extra))[:3]}\n   duckdb {sorted(map(str, missing))[:3]}"
    return None


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, names = (sys.argv[1:] + ["/root/testdata/sf0.01"])[0], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, folder, query, oracles[name])
            else:
                problem = None if query(spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "" if name in oracles else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - start:6.2f}s {name}{kind} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
