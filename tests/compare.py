"""Run registered queries on Spark and their reference SQL on DuckDB, and compare.

Usage: python -m tests.compare [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from ticketlens.plans.views import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "asDict"):
        return {k: _norm(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if type(v).__name__ == "Decimal":
        return float(v)
    if type(v).__name__ == "datetime":
        return v.replace(tzinfo=None).isoformat()
    return v


def _close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) and not isinstance(b, bool):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(_close(x, y) for x, y in zip(a, b))
    return a == b


def _key(row):
    return [
        (x is not None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in row
    ]


def compare(df, con, sql):
    """Return (rows, message); an empty message means equal."""
    cols = sorted(df.columns)
    spark_rows = [[_norm(r[c]) for c in cols] for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(spark_rows), f"columns {cols} vs {sorted(names)}"
    pos = [names.index(c) for c in cols]
    duck_rows = [[_norm(r[i]) for i in pos] for r in cur.fetchall()]
    if len(spark_rows) != len(duck_rows):
        return len(spark_rows), f"rows {len(spark_rows)} vs {len(duck_rows)}"
    spark_rows.sort(key=_key)
    duck_rows.sort(key=_key)
    for a, b in zip(spark_rows, duck_rows):
        if not all(_close(x, y) for x, y in zip(a, b)):
            diff = {c: (x, y) for c, x, y in zip(cols, a, b) if not _close(x, y)}
            return len(spark_rows), f"values {str(diff)[:500]} row {str(a)[:300]}"
        if any(type(x) is not type(y) and x is not None and y is not None
               for x, y in zip(a, b)):
            return len(spark_rows), f"types {[(c, type(x).__name__, type(y).__name__) for c, x, y in zip(cols, a, b) if type(x) is not type(y)]}"
    return len(spark_rows), ""


def main(argv):
    import __spark_entry__ as entry
    from ticketlens.plans.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session("8")
    con = duck(sf_dir)
    queries, reference = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in reference:
                rows, message = compare(df, con, reference[name])
            else:
                rows, message = len(df.collect()), ""
        except Exception as e:  # report and go on with the next query
            rows, message = -1, f"{type(e).__name__}: {str(e)[:1200]}"
        bad += bool(message)
        print(f"{'ok ' if not message else 'BAD'} {name} rows={rows} {time.time() - t0:.2f}s"
              f"{'' if name in reference else ' (no sql)'} {message}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
