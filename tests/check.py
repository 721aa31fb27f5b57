"""Run registered queries against their SQL in DuckDB: python tests/check.py [-s sf] [name-prefix ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, q, sf_dir):
    """Return (ok, message) for one query."""
    t0 = time.time()
    df = q(spark, sf_dir)
    names, rows = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if q.sql is None:
        return len(rows) > 0, f"rows={len(rows)} no-sql {took:.1f}s"
    t0 = time.time()
    cur = con.execute(q.sql)
    cols = [c[0] for c in cur.description]
    types = [str(c[1]) for c in cur.description]
    want_names, want = table(cols, cur.fetchall())
    note = f"rows={len(rows)} spark {took:.1f}s duckdb {time.time() - t0:.1f}s"
    if any("HUGEINT" in t or "DECIMAL" in t for t in types):
        note += f" TYPES {dict(zip(cols, types))}"
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return False, f"rows {len(rows)} != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b]
    if bad:
        return False, f"{note} {len(bad)} rows differ, first {bad[0]}"
    return True, note


def main() -> int:
    from hushline.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = "0.01"
    if "-s" in args:
        at = args.index("-s")
        sf = args[at + 1]
        del args[at : at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    entry.queries()
    from hushline.catalog.registry import QUERIES

    spark = local_session()
    con = connect(sf_dir)
    failed = []
    for name, q in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            ok, message = compare(spark, con, q, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
