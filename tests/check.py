"""Run registered queries against their SQL: python tests/check.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def tables_db(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _text(value) -> str:
    if value is None:
        return "\0null"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def compare(df, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both give the same columns and rows, else what differs."""
    result = db.execute(sql)
    expected_columns = [c[0] for c in result.description]
    expected = rows_of(expected_columns, result.fetchall())
    if sorted(df.columns) != sorted(expected_columns):
        return f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    found = rows_of(df.columns, df.collect())
    if found != expected:
        diff = next((p for p in zip(found, expected) if p[0] != p[1]), None)
        return f"rows {len(found)} / {len(expected)}, first difference {diff}"[:1500]
    return None


def main() -> int:
    from csilake.session import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    db = tables_db(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = compare(queries[name](spark, folder), db, sql[name]) if name in sql else "no sql"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("unmatched sql:", sorted(set(sql) - set(queries)), "failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
