"""Run registered queries and their SQL side by side.

``python -m tests.compare sf0.01 [name …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def spark_rows(df) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[n]) for n in names) for r in df.select(*names).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def differences(df, con, sql: str) -> list[str]:
    """Empty if the DataFrame and the SQL give the same columns and rows."""
    names, expected = sql_rows(con, sql)
    if sorted(df.columns) != names:
        return [f"columns {sorted(df.columns)} != {names}"]
    got = spark_rows(df)
    if got == expected:
        return []
    found = [f"rows {got.total()} != {expected.total()}"] if got.total() != expected.total() else []
    found += [f"only in Spark: {r}" for r in list((got - expected))[:3]]
    found += [f"only in SQL: {r}" for r in list((expected - got))[:3]]
    return found


def main(argv: list[str]) -> int:
    from tests.conftest import new_session

    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"{TESTDATA}/{argv[0]}"
    spark, con, bad = new_session(), connect(sf_dir), 0
    sql = oracle_sql()
    for name, run in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else []
            note = "" if name in sql else " (rows only)"
            rows = df.count() if name not in sql else ""
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            found, note, rows = [f"{type(e).__name__}: {str(e)[:600]}"], "", ""
        bad += bool(found)
        print(f"{'BAD' if found else 'ok '} {name}{note} {rows} {time.time() - start:.2f}s", *found, sep="\n      " if found else " ", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
