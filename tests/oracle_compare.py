"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle_compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value):
    """One spelling per value, whatever engine it came from."""
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf):
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return connection


def compare(spark, connection, sf, name, query, sql):
    """None when equal, else what differs."""
    got = query(spark, sf)
    columns = got.columns
    rows = normal(columns, [tuple(r) for r in got.collect()])
    if sql is None:
        return None if rows else "no rows"
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    expected_columns = [d[0] for d in described]
    if sorted(columns) != sorted(expected_columns):
        return f"columns {sorted(columns)} != {sorted(expected_columns)}"
    kinds = {d[0]: d[1] for d in described}
    expected = normal(expected_columns, connection.execute(sql).fetchall())
    types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    for c in columns:
        integral = types[c] in ("int", "bigint", "smallint")
        if integral != any(k in kinds[c] for k in ("INT",)):
            return f"type of {c}: {types[c]} != {kinds[c]}"
        if (types[c] == "double") != (kinds[c] in ("DOUBLE", "FLOAT")):
            return f"type of {c}: {types[c]} != {kinds[c]}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}"
    if rows != expected:
        only = [r for r in rows if r not in set(expected)][:3]
        missing = [r for r in expected if r not in set(rows)][:3]
        return f"values ({sorted(columns)}): got {only} expected {missing}"
    if not rows:
        return "equal but empty"
    return None


def main():
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf)
    all_queries, sql = queries(), oracle_sql()
    bad = 0
    for name, query in all_queries.items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            problem = compare(spark, connection, sf, name, query, sql.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        note = "ok" if name in sql else "ok (rows only)"
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
