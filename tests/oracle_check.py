"""Run registered queries in Spark and their DuckDB twins; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, column names and types, and an exact,
order-insensitive value comparison (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from penmark.session import local_session  # noqa: E402

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(v)  # exact: both engines must produce the same double
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(rows: list[tuple], cols: list[str]) -> tuple[str, list[str]]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as entry

    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs = entry.queries()
    sql = entry.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sql:
            print(f"{name:28s} rows={len(srows)} (rows-only) {ts:.1f}s")
            continue
        try:
            res = con.execute(sql[name])
            dcols = [d[0] for d in res.description]
            drows = [tuple(r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} DUCKDB ERROR {str(e)[:300]}")
            bad += 1
            continue
        hs, ls = digest(srows, scols)
        hd, ld = digest(drows, dcols)
        stypes = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
        dtypes = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql[name]}").fetchall()}
        type_ok = all(stypes[c] == dtypes.get(c) for c in stypes)
        ok = sorted(scols) == sorted(dcols) and len(srows) == len(drows) and hs == hd and type_ok
        status = "OK" if ok else "MISMATCH"
        print(f"{name:28s} {status} rows={len(srows)}/{len(drows)} {ts:.1f}s")
        if not ok:
            bad += 1
            if sorted(scols) != sorted(dcols):
                print("   cols", sorted(scols), sorted(dcols))
            if not type_ok:
                print("   types", {c: (stypes[c], dtypes.get(c)) for c in stypes if stypes[c] != dtypes.get(c)})
            sd, dd = set(ls), set(ld)
            for x in sorted(sd - dd)[:3]:
                print("   spark only:", x[:300])
            for x in sorted(dd - sd)[:3]:
                print("   duck only: ", x[:300])
    print("bad", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
