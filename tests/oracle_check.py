"""Run registered queries against their DuckDB oracle (what the driver's verify does).

Columns are compared by name; rows order-insensitively; values exactly (doubles must be
bit-identical, NaN equals NaN). Usage: ``python tests/oracle_check.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (2, repr(float(v)))
    if isinstance(v, (list, tuple)):
        return (3, repr([_norm(x) for x in v]))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, bool):
        return (4, repr(v))
    if isinstance(v, int):
        return (2, repr(float(v)) if abs(v) < 2**53 else repr(v))
    return (5, str(v))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records), [columns[i] for i in order]


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "array<bigint>": "BIGINT[]", "float": "FLOAT", "smallint": "SMALLINT"}


def compare(spark_df, sql: str, con) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_types = dict(spark_df.dtypes)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    bad_types = [(c, s_types[c], d_types.get(c)) for c in s_cols
                 if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types.get(c)]
    if bad_types:
        return False, f"types differ: {bad_types}"
    a, names = rows_of(s_cols, s_rows)
    b, _ = rows_of(d_cols, d_rows)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        diff = [(names[i], x[i], y[i]) for i in range(len(names)) if x[i] != y[i]]
        return False, f"{len(bad)} of {len(a)} rows differ; first: {diff[:6]}"
    return True, f"{len(a)} rows"


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as E
    from flowlens.session import local_session
    spark = local_session()
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    failed = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        if name not in oracle:
            n = fn(spark, sf_dir).count()
            print(f"{name:32s} ROWS-ONLY {n} rows ({time.time() - t:.1f}s)", flush=True)
            continue
        try:
            ok, msg = compare(fn(spark, sf_dir), oracle[name], con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t:.1f}s)", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
