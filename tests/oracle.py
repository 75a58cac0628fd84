"""Compare each query with its SQL on DuckDB: python tests/oracle.py <sf_dir> [query ...]."""

from __future__ import annotations

import os
import sys
import time
from datetime import datetime

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    for name in ("integer", "floating", "decimal", "timestamp", "date", "boolean", "list", "null"):
        if getattr(pa.types, f"is_{name}")(t):
            return name
    return "string" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def rows_of(table: pa.Table) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return "<null>"
        return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime) else repr(v)

    columns = [[cell(v) for v in table.column(c).to_pylist()] for c in sorted(table.column_names)]
    return sorted(zip(*columns))


def differences(spark_df, sql: str, con) -> str | None:
    """None when the results agree, else a short description."""
    got, want = spark_df.toArrow(), con.sql(sql).to_arrow_table()
    names = sorted(got.column_names)
    if names != sorted(want.column_names):
        return f"columns {names} vs {sorted(want.column_names)}"
    kinds = {c: (kind(got.schema.field(c).type), kind(want.schema.field(c).type)) for c in names}
    if odd := {c: k for c, k in kinds.items() if k[0] != k[1]}:
        return f"types {odd}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows of {names}: {bad[0][0]!s:.500} vs {bad[0][1]!s:.500}" if bad else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from reviewmill.session import build_session

    spark = build_session(f"local[{os.environ.get('CPUS', '8')}]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, sql = duck(sf_dir), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if name not in sql or (names and name not in names):
            continue
        started = time.time()
        try:
            bad = differences(run(spark, sf_dir), sql[name], con)
        except Exception as e:  # report and go on
            bad = f"{type(e).__name__}: {e!s:.500}"
        failed += bad is not None
        print(f"\n{'ok  ' if bad is None else 'FAIL'} {name} {time.time() - started:.1f}s {bad or ''}", flush=True)
    missing = sorted(set(sql) - set(queries()))
    print(f"\nRESULT {failed} failed; SQL without query: {missing}; no SQL: {sorted(set(queries()) - set(sql))}")
