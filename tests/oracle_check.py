"""Runs registered queries in Spark and their SQL checks in DuckDB and compares all rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    """One spelling per value, whichever engine it came from."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None if v is None else "NaN"
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


KINDS = {"int": "int", "bigint": "bigint", "double": "double", "string": "string", "boolean": "boolean", "date": "date",
         "integer": "int", "varchar": "string", "hugeint": "HUGEINT"}


def compare(spark, con, name: str, folder: str) -> str | None:
    import __spark_entry__

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    df = QUERIES[name](spark, folder)
    left_cols = sorted(df.columns)
    rows = df.select(*left_cols).collect()
    left = sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    if name not in ORACLES:
        return None if rows else "no rows"
    rel = con.sql(ORACLES[name])
    right_cols = sorted(rel.columns)
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    types = dict(zip(rel.columns, [str(t).lower() for t in rel.types]))
    odd = [(c, t, types[c]) for c, t in df.dtypes if KINDS.get(types[c], types[c]) != t and "[]" not in types[c] and "struct" not in types[c]]
    order = [rel.columns.index(c) for c in right_cols]
    right = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ ({left_cols}):\n   spark {bad[0][0]}\n   check {bad[0][1]}"
    if odd:
        return f"types differ {odd}"
    return None if left else "no rows"


def main() -> int:
    import __spark_entry__
    from rivalry.session import local_session

    QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    names = [n for n in QUERIES if not wanted or any(n == w or n.startswith(w) for w in wanted)]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, folder)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        mark = "ok  " if problem is None else "FAIL"
        failed += problem is not None
        print(f"{mark} {name} {time.time() - start:.1f}s{'' if name in ORACLES else ' (rows only)'}"
              + ("" if problem is None else f" {problem}"), flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
