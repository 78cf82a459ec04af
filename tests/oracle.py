"""Run registered queries on Spark and their oracle SQL on DuckDB and compare the values.

``python -m tests.oracle [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TESTDATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, (float, np.floating)):
        return None if math.isnan(value) else f"{round(float(value), 6) + 0.0:.6f}"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, (list, tuple, np.ndarray)):
        return repr([_cell(v) for v in value])
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def kind(type_name: str) -> str:
    t = type_name.lower()
    if any(x in t for x in ("int", "long")):
        return "int"
    if any(x in t for x in ("double", "float", "decimal")):
        return "float"
    return t.split("(")[0].replace("varchar", "string")


def compare(spark_df, con, sql: str):
    """Return (ok, message)."""
    cols = spark_df.columns
    got = canonical(cols, spark_df.collect())
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want_types = {d[0]: kind(str(d[1])) for d in rel.description}
    want = canonical(want_cols, rel.fetchall())
    if sorted(cols) != sorted(want_cols):
        return False, f"columns {sorted(cols)} != {sorted(want_cols)}"
    got_types = {f.name: kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    bad = {c: (got_types[c], want_types[c]) for c in cols if got_types[c] != want_types[c] and "bool" not in got_types[c]}
    if bad:
        return False, f"types {bad}"
    if got != want:
        got_set, want_set = set(got), set(want)
        only_got = [r for r in got if r not in want_set][:3]
        only_want = [r for r in want if r not in got_set][:3]
        return False, f"rows {len(got)} vs {len(want)}; cols {sorted(cols)}; spark only {only_got}; sql only {only_want}"
    return True, f"{len(got)} rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from kbspark.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = os.path.join(TESTDATA, f"sf{sf}")
    spark = local_session(app="oracle")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = []
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                ok, msg = compare(df, con, oracles[name])
            else:
                ok, msg = True, f"{df.count()} rows, no oracle"
        except Exception as err:  # report and go on with the next query
            ok, msg = False, f"{type(err).__name__}: {str(err)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t0:.1f}s {msg[:1500]}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
