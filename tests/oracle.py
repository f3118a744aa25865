"""Run registered queries in Spark and their SQL twins in DuckDB and compare the results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9f}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir) -> dict:
    """One row of the comparison: counts, column names, and the multiset of normalised rows."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    out = {"name": name, "rows": len(rows), "spark_s": round(t1 - t0, 1), "ok": True, "why": ""}
    if sql is None:
        out["why"] = "rows only"
        return out
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    out["duck_s"] = round(time.time() - t1, 1)
    if sorted(cols) != sorted(df.columns):
        out.update(ok=False, why=f"columns {sorted(df.columns)} vs {sorted(cols)}")
        return out
    stypes = dict(df.dtypes)
    bad = [c for c, t in zip(cols, types)
           if (t in ("DOUBLE", "FLOAT")) != (stypes[c] == "double") or t in ("HUGEINT", "UBIGINT") or t.startswith("DECIMAL")
           or (t in ("BIGINT", "INTEGER")) != (stypes[c] == "bigint" or stypes[c] == "int" and t == "INTEGER") or (t == "BOOLEAN") != (stypes[c] == "boolean")]
    if bad:
        out["why"] = "types " + str([(c, stypes[c], dict(zip(cols, types))[c]) for c in bad])
        out["ok"] = False
    order = sorted(cols)
    a = sorted(tuple(_norm(r[c]) for c in order) for r in rows)
    ix = [cols.index(c) for c in order]
    b = sorted(tuple(_norm(r[i]) for i in ix) for r in want)
    if a != b:
        diff_a = [r for r in a if r not in set(b)][:2]
        diff_b = [r for r in b if r not in set(a)][:2]
        out.update(ok=False, why=out["why"] + f" {order} rows {len(a)} vs {len(b)}\n   spark {diff_a}\n   duck  {diff_b}")
    return out
