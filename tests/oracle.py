"""Runs registered queries against their SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(got), "ok": None, "spark_s": t1 - t0, "why": "rows only"}
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    res = {"name": name, "rows": len(got), "spark_s": t1 - t0, "duck_s": t2 - t1}
    if sorted(df.columns) != sorted(want_cols):
        return {**res, "ok": False, "why": f"columns {sorted(df.columns)} vs {sorted(want_cols)}"}
    a = rows_of(df.columns, [tuple(r) for r in got])
    b = rows_of(want_cols, want)
    kinds = dict(zip(want_cols, (str(d[1]) for d in cur.description)))
    types = [f"{f.name}: {f.dataType.simpleString()}/{kinds[f.name]}" for f in df.schema.fields
             if SAME.get(f.dataType.simpleString()) != kinds[f.name]]
    if types:
        res["types"] = types
    if len(a) != len(b):
        return {**res, "ok": False, "why": f"rows {len(a)} vs {len(b)}: {a[:2]} | {b[:2]}"}
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return {**res, "ok": False, "why": f"{len(bad)} differ, e.g. {sorted(df.columns)} {bad[0]}"}
    return {**res, "ok": True, "why": ""}


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from imagora.session import local_session

    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1]))
                                               for a in argv)]
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, sf, n, qs[n], sqls.get(n))
        except Exception as ex:  # noqa: BLE001
            r = {"name": n, "ok": False, "rows": -1, "spark_s": 0, "why": str(ex)[:700]}
        bad += r["ok"] is False
        empty = "  EMPTY" if r["rows"] == 0 else ""
        print(f"{'OK ' if r['ok'] else '-- ' if r['ok'] is None else 'BAD'} {n:28s} rows={r['rows']:<8d}"
              f" spark={r['spark_s']:.1f}s duck={r.get('duck_s', 0):.1f}s {r['why']}{empty}"
              f"{'  TYPES ' + ', '.join(r['types']) if r.get('types') else ''}", flush=True)
    print("failed:", bad, "of", len(names))


if __name__ == "__main__":
    main(sys.argv[1:])
