"""Comparison of a query with its SQL, run by DuckDB on the same parquet files."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if hasattr(value, "asDict"):
        return tuple(_plain(v) for v in value)
    return value


def _sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, kinds, row count or values; empty when equal."""
    rows = [tuple(_plain(v) for v in r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = [tuple(_plain(v) for v in r) for r in cur.fetchall()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    pick = lambda cols, data: sorted(
        (tuple(r[cols.index(c)] for c in order) for r in data), key=_sort_key
    )
    left, right = pick(df.columns, rows), pick(names, expected)
    if len(left) != len(right):
        return [f"{len(left)} rows != {len(right)}"]
    for i, c in enumerate(order):
        a = {type(r[i]).__name__ for r in left if r[i] is not None}
        b = {type(r[i]).__name__ for r in right if r[i] is not None}
        if a != b:
            return [f"column {c} has {a} != {b}"]
    bad = [
        (a, b) for a, b in zip(left, right)
        if any(
            x != y and not (isinstance(x, float) and isinstance(y, float)
                            and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b)
        )
    ]
    return [f"{len(bad)} of {len(left)} rows differ, first: {order} {bad[0]}"] if bad else []


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from marketloom.plans.catalog import QUERIES, SQL
    from marketloom.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:] or list(QUERIES)
    spark, con = local_session(), connect(sf_dir)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in SQL:
                problems = compare(df, con, SQL[name])
                note = f"{df.count() if problems else ''}"
            else:
                problems, note = [], f"{len(df.collect())} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            problems, note = [f"{type(error).__name__}: {str(error)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}",
              *problems, flush=True)
    print("failed:", failed, "of", len(wanted))
    return failed


if __name__ == "__main__":
    sys.exit(main())
