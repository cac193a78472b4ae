"""Compare registered queries with their SQL twins: python tests/check_oracles.py [-s SF] [prefix ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql):
    """Problems found, as text; empty when both sides agree."""
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        close = sum(
            all(a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
                for a, b in zip(g, w)) for g, w in bad)
        types = {c: (type(a).__name__, type(b).__name__) for c, a, b in zip(got_cols, *bad[0]) if type(a) is not type(b)}
        return f"{len(bad)} rows differ ({close} by float noise) {types} cols={got_cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}", len(got)
    return "", len(got)


def main(argv):
    scale = "0.01"
    if argv and argv[0] == "-s":
        scale, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{scale}"
    import __spark_entry__ as entry
    from tidemark.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(folder)
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = "", len(df.collect())
        except Exception as exc:  # report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:900]}", -1
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        failed += bool(problem)
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
