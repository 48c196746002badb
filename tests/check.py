"""Run registered queries against their SQL twins: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(base: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{base}/{name}.parquet'")
    return con


def plain(value):
    import decimal

    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    return value


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(con, df, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark {sorted(df.columns)} sql {sorted(names)}"
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}"
    if got != want:
        both = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(both)} values differ, e.g.\n   spark {both[0][0][:300]}\n   sql   {both[0][1][:300]}"
    return None if got else "empty"


def main() -> int:
    from tests.session import spark_session
    from tidemark.catalog import cases

    args = sys.argv[1:]
    base = f"/root/testdata/sf{args[0] if args else '0.01'}"
    wanted = args[1:]
    spark = spark_session()
    con = duck(base)
    bad = 0
    for name, case in cases().items():
        if wanted and not any(name == w or name.startswith(w + "_") for w in wanted):
            continue
        begin = time.time()
        try:
            df = case.run(spark, base)
            problem = compare(con, df, case.sql) if case.sql else (None if df.count() else "empty")
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - begin
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s{'' if case.sql else ' (rows only)'}{'' if problem is None else ' ' + problem}", flush=True)
        bad += problem is not None
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
