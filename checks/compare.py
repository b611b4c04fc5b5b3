"""Compare registered queries with their SQL: python -m checks.compare [sf] [name ...]"""

from __future__ import annotations

import sys
import time

import duckdb

from checks.queries import ORACLES, QUERIES
from crawlframe.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_rows(sf_dir: str, text: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    result = con.execute(text)
    names = [d[0] for d in result.description]
    return names, result.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = [tuple(repr(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(shown)


def compare(spark, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    right = canonical(*oracle_rows(sf_dir, ORACLES[name]))
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        ours, theirs = set(left[1]), set(right[1])
        return (
            f"rows {len(left[1])} vs {len(right[1])}; only here {sorted(ours - theirs)[:3]}; "
            f"only in SQL {sorted(theirs - ours)[:3]}"
        )
    return None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session()
    failed = 0
    for name in names:
        began = time.time()
        try:
            if name in ORACLES:
                fault = compare(spark, name, f"/root/testdata/sf{sf}")
            else:
                fault = None if QUERIES[name](spark, f"/root/testdata/sf{sf}").columns else "no columns"
        except Exception as error:
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += fault is not None
        print(f"{'ok  ' if fault is None else 'FAIL'} {name} {time.time() - began:.1f}s {fault or ''}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
