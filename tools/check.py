"""Compare registered queries with their DuckDB SQL.

usage: python tools/check.py [--sf 0.01] [--only substr,substr] [--module name]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (dt.date, dt.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    import duckdb

    from pressgrain.plans import ORACLES, QUERIES
    from pressgrain.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--module", default="")
    args = ap.parse_args()
    base = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for f in Path(base).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    keys = list(QUERIES)
    if args.module:
        keys = [k for k in keys if any(m in QUERIES[k].__wrapped_module__ for m in args.module.split(","))]
    if args.only:
        keys = [k for k in keys if any(k == o for o in args.only.split(","))]
    bad = 0
    for key in keys:
        t0 = time.time()
        try:
            df = QUERIES[key](spark, base)
            cols = sorted(df.columns)
            rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
            types = dict(df.dtypes)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {key}: spark {str(e)[:700]}")
            continue
        took = time.time() - t0
        if key not in ORACLES:
            print(f"rows {key}: {len(rows)} rows {took:.1f}s" + ("  EMPTY" if not rows else ""))
            continue
        try:
            t0 = time.time()
            cur = con.execute(ORACLES[key])
            names = [c[0] for c in cur.description]
            otypes = {c[0]: str(c[1]) for c in cur.description}
            got = cur.fetchall()
            otook = time.time() - t0
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {key}: duckdb {str(e)[:700]}")
            continue
        order = sorted(range(len(names)), key=lambda i: names[i])
        onames = [names[i] for i in order]
        if onames != cols:
            bad += 1
            print(f"FAIL {key}: columns {cols} vs {onames}")
            continue
        a = sorted([tuple(norm(v) for v in r) for r in rows], key=repr)
        b = sorted([tuple(norm(r[i]) for i in order) for r in got], key=repr)
        tmap = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "INTEGER": "int",
                "NUMBER": "?", "STRING": "string"}
        tdiff = {c: (types[c], otypes[c]) for c in cols if tmap.get(otypes[c], otypes[c]) not in (types[c], "?")}
        if a != b:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL {key}: {len(a)} vs {len(b)} rows; types {tdiff}; cols {cols}")
            print("   spark only", sorted(sa - sb, key=repr)[:3])
            print("   sql only  ", sorted(sb - sa, key=repr)[:3])
        else:
            print(f"ok   {key}: {len(a)} rows {took:.1f}s / {otook:.1f}s" + (f" TYPES {tdiff}" if tdiff else "") + ("  EMPTY" if not a else ""))
    print(f"{len(keys)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
