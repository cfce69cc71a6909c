"""Compare every query with its checking SQL: ``python tests/check_queries.py [scale] [names...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from siftworks.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None if the query and its SQL give the same rows, else what differs."""
    sql = entry.oracle_sql().get(name)
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = Counter(tuple(tuple(x) if isinstance(x, list) else x for x in row) for row in frame.select(*columns).collect())
    if sql is None:
        return f"rows only ({sum(ours.values())})"
    result = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    if ours == theirs:
        return None
    return (
        f"{sum(ours.values())} rows vs {sum(theirs.values())}; only ours {list((ours - theirs).items())[:2]}; "
        f"only theirs {list((theirs - ours).items())[:2]}"
    )


def main() -> int:
    scale, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    sf_dir = f"/root/testdata/{scale}"
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for name in entry.queries():
        if names and name not in names:
            continue
        start = time.time()
        try:
            difference = compare(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            difference = f"ERROR {str(error)[:800]}"
        known = difference is None or difference.startswith("rows only")
        bad += not known
        print(f"{'ok  ' if known else 'BAD '} {name:26s} {time.time() - start:6.2f}s {difference or ''}"[:1500], flush=True)
    print("differences:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
