"""Run a query on Spark and its SQL on DuckDB and compare whole results.

``python -m tests.compare [folder [query ...]]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    base = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            base.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return base


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def kind(value) -> str:
    return type(value).__name__


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(cleaned, key=lambda r: tuple((v is None, str(kind(v)), v if v is not None else 0) for v in r))


def differences(spark_df, sql: str, base) -> list[str]:
    """Empty if the two results agree in column names, row count, value kinds and values."""
    cursor = base.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows against {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w or [kind(x) for x in g] != [kind(x) for x in w]]
    if bad:
        return [f"{len(bad)} of {len(got)} rows differ in {sorted(names)}, first {bad[0]}"]
    return []


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as catalogue

    from phonolake.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, base = local_session(8), connect(folder)
    wrong = 0
    for name in names:
        if name not in sql:
            print(f"{name:28s} no SQL")
            continue
        begun = time.time()
        try:
            found = differences(queries[name](spark, folder), sql[name], base)
        except Exception as error:  # noqa: BLE001
            found = [f"{kind(error)}: {str(error)[:500]}"]
        wrong += bool(found)
        print(f"{name:28s} {time.time() - begun:6.2f}s {'ok' if not found else str(found[0])[:900]}", flush=True)
    return wrong


if __name__ == "__main__":
    sys.exit(main())
