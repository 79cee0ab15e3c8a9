"""python tests/oracle_compare.py [SF_DIR] [NAME...]: run queries beside their oracle SQL and compare rows."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry


def tables(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf):
    df = entry.queries()[name](spark, sf)
    t = time.time()
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"{name}: {len(got)} rows, no oracle, {took:.1f}s", True
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"{name}: columns differ {sorted(df.columns)} {sorted(cols)}", False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"{name}: ok {len(a)} rows, {took:.1f}s", True
    return f"{name}: DIFFERENT {len(a)} vs {len(b)}; only here {list(set(a) - set(b))[:3]}; only oracle {list(set(b) - set(a))[:3]}", False


if __name__ == "__main__":
    from sessionloom.runtime import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = tables(sf)
    fine = True
    for name in args or entry.queries():
        try:
            text, ok = compare(spark, con, name, sf)
        except Exception as e:
            text, ok = f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", False
        fine &= ok
        print(text, flush=True)
    sys.exit(not fine)
