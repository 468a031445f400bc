"""Compare registered queries with their SQL on the same parquet tables (needs duckdb)."""

import glob
import math
import os
import sys
import time


def _cell(value):
    if value is None:
        return "\\N"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if value != int(value) or abs(value) > 1e15 else str(int(value))
    if hasattr(value, "quantize"):
        return _cell(float(value))
    return str(value)


def compare(spark, folder: str, names: list[str] | None = None) -> dict[str, tuple]:
    import duckdb

    from docflow.plans.catalogue import oracle_sql, queries

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sql = oracle_sql()
    out = {}
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = fn(spark, folder)
            cols = sorted(got.columns)
            rows = sorted(tuple(_cell(r[c]) for c in cols) for r in got.collect())
        except Exception as error:  # noqa: BLE001 - the report shows the failure
            out[name] = ("ERROR", str(error)[:600])
            print(f"{name:32s} ERROR {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - start
        if name not in sql:
            out[name] = ("ROWS", len(rows))
            print(f"{name:32s} ROWS {len(rows)} {spent:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            cur = con.execute(sql[name])
            names_sql = [d[0] for d in cur.description]
            raw = cur.fetchall()
            spent_sql = time.time() - start
        except Exception as error:  # noqa: BLE001
            out[name] = ("SQLERROR", str(error)[:600])
            print(f"{name:32s} SQLERROR {str(error)[:600]}", flush=True)
            continue
        order = sorted(range(len(names_sql)), key=lambda i: names_sql[i])
        want = sorted(tuple(_cell(r[i]) for i in order) for r in raw)
        good = [names_sql[i] for i in order] == cols and rows == want
        out[name] = ("OK" if good else "DIFF", len(rows))
        print(f"{name:32s} {'OK' if good else 'DIFF'} {len(rows)}/{len(want)} {spent:.1f}s sql {spent_sql:.1f}s", flush=True)
        if not good:
            print("  columns", cols, [names_sql[i] for i in order])
            only = [r for r in rows if r not in set(want)][:3]
            missing = [r for r in want if r not in set(rows)][:3]
            print("  only here", only, "\n  only sql ", missing, flush=True)
    return out


if __name__ == "__main__":
    from docflow import get_session

    session = get_session()
    session.sparkContext.setLogLevel("ERROR")
    result = compare(session, sys.argv[1], sys.argv[2:])
    print({k: v for k, v in result.items() if v[0] not in ("OK", "ROWS")})
