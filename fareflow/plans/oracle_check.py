"""Compare registered queries with their DuckDB oracles (development tool).

Mirrors the driver's gate: row count, column names, and an
order-insensitive hash of the values, columns sorted by name.
Usage: ``python -m fareflow.plans.oracle_check SF_DIR [name ...]``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import hashlib
import sys
import time

from ..sources.tables import BASE_TABLES


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    if isinstance(v, dict):
        return str(sorted((str(k), _norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    import os
    for t in BASE_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p}'")
    return con


def compare(spark, sf_dir: str, names=None, verbose=True) -> dict[str, dict]:
    import importlib
    entry = importlib.import_module("__spark_entry__")
    qs, ors = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for name in names or sorted(qs):
        t0 = time.time()
        df = qs[name](spark, sf_dir)
        rows = df.collect()
        t1 = time.time()
        res = {"rows": len(rows), "spark_sec": round(t1 - t0, 2)}
        if name in ors:
            cur = con.execute(ors[name])
            cols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            res["oracle_rows"] = len(drows)
            res["schema_ok"] = sorted(cols) == sorted(df.columns)
            res["hash_ok"] = digest(df.columns, rows) == digest(cols, drows)
            if not res["hash_ok"] and verbose:
                a = {"|".join(_norm(r[i]) for i in sorted(range(len(df.columns)), key=lambda i: df.columns[i])) for r in rows}
                b = {"|".join(_norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in drows}
                res["spark_only"] = sorted(a - b)[:3]
                res["oracle_only"] = sorted(b - a)[:3]
                if sorted(cols) != sorted(df.columns):
                    res["cols"] = (sorted(df.columns), sorted(cols))
        out[name] = res
        if verbose:
            print(name, res, flush=True)
    return out


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from ..session import local_session
    spark = local_session()
    r = compare(spark, sys.argv[1], sys.argv[2:] or None)
    bad = [k for k, v in r.items() if "hash_ok" in v and not (v["hash_ok"] and v["schema_ok"])]
    print("FAILED:", bad)
