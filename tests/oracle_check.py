"""Run queries against their SQL on DuckDB, the way the gate compares them."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    return str(v)


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return True, f"{sum(got.values())} rows"
    a, b = got - want, want - got
    return False, f"{sum(got.values())} vs {sum(want.values())} rows\n   spark {list(a)[:2]}\n   sql   {list(b)[:2]}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from driftmap.session import local_session

    sf_dir = sys.argv[1]
    prefix = tuple(sys.argv[2:]) or ("",)
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if not name.startswith(prefix):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"{df.count()} rows, no SQL"
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - t:6.1f}s {note}", flush=True)
    print("bad:", bad)
