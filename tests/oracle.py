"""Compare registered queries with their SQL form. Usage: python -m tests.oracle [sf] [key-prefix ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, v)
    return (1, v)


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(out, key=repr), [columns[i] for i in order]


def compare(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    got, got_cols = _sorted(df.columns, [tuple(x) for x in df.collect()])
    rel = con.sql(sql)
    want, want_cols = _sorted(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b or [type(x[1]) for x in a] != [type(x[1]) for x in b]:
            return f"{dict(zip(got_cols, a))} != {dict(zip(got_cols, b))}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from scorelens.session import local_session

    sf = argv[0] if argv else "0.01"
    prefixes = tuple(argv[1:])
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    oracles, bad, rows = entry.oracle_sql(), 0, 0
    for key, fn in entry.queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if key in oracles:
                problem = compare(df, con, oracles[key])
            else:
                rows = len(df.collect())
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql" if key in oracles else f"rows={rows}"
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} [{kind}] {took:.2f}s {problem or ''}", flush=True)
        bad += problem is not None
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
