"""Side-by-side comparison of a registered query and its DuckDB oracle."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return ("n",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, decimal.Decimal):
        return ("f", float(v))
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("d", str(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    return ("s", str(v))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, otherwise a short description."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; first diff {diff(cols, got, want)}"
    if got != want:
        bad = sum(a != b for a, b in zip(got, want))
        return f"{bad}/{len(got)} rows differ: {diff(cols, got, want)}"
    return None if got else "empty"


def diff(cols, got, want):
    gs, ws = set(got), set(want)
    a = [g for g in got if g not in ws][:2]
    b = [w for w in want if w not in gs][:2]
    def show(rows):
        return [{c: v for c, v in zip(cols, r)} for r in rows]
    if len(a) == 1 or (a and b):
        return {"cols": [c for c, x, y in zip(cols, a[0], b[0] if b else a[0]) if x != y], "got": show(a[:1]), "want": show(b[:1])}
    return {"got": show(a), "want": show(b)}


if __name__ == "__main__":
    import __spark_entry__ as e
    from tickloom.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            if name in os_:
                problem = compare(spark, con, name, fn, os_[name], sf)
            else:
                n = fn(spark, sf).count()
                problem = None if n else "empty"
                name += f" [rows only: {n}]"
        except Exception as ex:  # noqa: BLE001
            problem = f"{type(ex).__name__}: {str(ex)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t0:.1f}s", "" if problem is None else problem, flush=True)
        failed += problem is not None
    print("failed", failed, "of", len(qs), "with oracle", len(os_))
