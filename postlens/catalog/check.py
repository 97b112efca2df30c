"""Compare registered queries with their checking SQL on one data folder.

    python -m postlens.catalog.check /root/testdata/sf0.01 [name-part ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

from . import ORACLES, QUERIES
from ..fixtures import BASE


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 1e9 else str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def duck(root: str):
    import duckdb

    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def compare(spark, con, name: str, root: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, root)
    got = df.collect()
    took = f"spark {time.time() - start:.1f}s "
    if name not in ORACLES:
        return True, took + f"rows only: {len(got)}"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = canonical(got, df.columns), canonical(want, cols)
    if a == b:
        return True, took + f"{len(a)} rows"
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    only_a, only_b = list((ca - cb).elements()), list((cb - ca).elements())
    return False, f"{len(a)} vs {len(b)} rows; {len(only_a)} differ; cols {sorted(cols)}\n    spark {only_a[:2]}\n    duck  {only_b[:2]}"


def main(root: str, parts: list[str]) -> int:
    from ..session import build_session

    spark = build_session("check", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(root)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, root)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:45s} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
