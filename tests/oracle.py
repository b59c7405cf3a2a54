"""Compares queries with their SQL: python -m tests.oracle [SF_DIR] [NAME...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings report_long fetch_results stale_bulletins "
    "contacts consecutive_failures site_health bulletin_index parish_names eval_items mix_targets split_limits"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return (v.replace(tzinfo=None) if v.tzinfo is None else v.astimezone(dt.timezone.utc).replace(tzinfo=None)).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def compare(df, con, sql: str) -> str:
    """Empty if both give the same bag of rows."""
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    want = Counter(tuple(cell(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    got = Counter(tuple(cell(r[c].asDict() if hasattr(r[c], "asDict") else r[c]) for c in cols) for r in df.collect())
    if want == got:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"


def main(argv: list[str]) -> int:
    import __spark_entry__ as e

    from almanac.session import local_session

    sf = argv[0] if argv and "/" in argv[0] else "/root/testdata/sf0.01"
    names = [a for a in argv if "/" not in a]
    spark, con, qs, sqls, bad = local_session(), connect(sf), e.queries(), e.oracle_sql(), 0
    for n in qs:
        if names and n not in names:
            continue
        t = time.time()
        try:
            if n in sqls:
                why = compare(qs[n](spark, sf), con, sqls[n])
                rows = ""
            else:
                rows, why = f" {qs[n](spark, sf).count()} rows, no SQL", ""
        except Exception as x:  # noqa: BLE001
            why, rows = f"{type(x).__name__} {str(x)[:600]}", ""
        bad += bool(why)
        print(f"{'BAD' if why else 'ok '} {n} {time.time() - t:.1f}s{rows} {why}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
