"""Runs registered queries against their DuckDB oracle: python tests/oracle_check.py [sf] [name part …]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(value):
    import datetime
    import decimal
    import math

    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value) if value != value.to_integral_value() else int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.6f}"
    if isinstance(value, int):
        return f"{value:.6f}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([normal(r[i]) for i in order]) for r in rows), [columns[i] for i in order]


def compare(spark, folder, name, query, sql, connection):
    df = query(spark, folder)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "rows", len(got), ""
    found = connection.sql(sql)
    want, want_columns = rows_of(found.columns, found.fetchall())
    if got_columns != want_columns:
        return "COLUMNS", len(got), f"{got_columns} != {want_columns}"
    if got != want:
        pairs = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return "DIFF", len(got), f"{len(got)} vs {len(want)}: {pairs}"
    return "ok", len(got), ""


def connect(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


if __name__ == "__main__":
    import __spark_entry__ as entry
    from siftstone.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.time()
        try:
            verdict, n, detail = compare(spark, folder, name, query, oracles.get(name), connection)
        except Exception as exc:  # noqa: BLE001
            verdict, n, detail = "ERROR", 0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:8}{name:36}{n:8} rows {time.time() - begin:6.1f}s {detail[:900]}", flush=True)
    print("failures:", bad)
    spark.stop()
