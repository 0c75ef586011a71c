"""Compare registered queries with their SQL on DuckDB.

    python tests/check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(_norm(v) for v in value.values())
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """Empty string when equal, else a short description."""
    import pyarrow as pa

    table = df.toArrow()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(table.column_names) != sorted(names):
        return f"columns {sorted(table.column_names)} != {sorted(names)}"
    got = list(zip(*[c.to_pylist() for c in table.columns])) if table.num_rows else []
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows_of(table.column_names, got), rows_of(names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first: {bad[0][0]} != {bad[0][1]}"
    kinds = {}
    duck = con.execute(f"describe {sql}").fetchall()
    for row in duck:
        kinds[row[0]] = row[1]
    notes = []
    for field in table.schema:
        d = kinds[field.name]
        pairs = {"int64": "BIGINT", "int32": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "bool": "BOOLEAN"}
        want_kind = pairs.get(str(field.type))
        if want_kind and want_kind != d and not (want_kind in ("BIGINT", "INTEGER") and d in ("BIGINT", "INTEGER")):
            notes.append(f"{field.name}: {field.type} vs {d}")
    return "TYPES " + "; ".join(notes) if notes else ""


def main() -> int:
    import __spark_entry__ as entry

    from yardstream import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                          "spark.sql.warehouse.dir": "/tmp/yardstream-warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not args.names or n in args.names]:
        t0 = time.time()
        try:
            df = queries[name](spark, args.sf)
            if name in oracle:
                message = compare(df, con, oracle[name])
            else:
                message = f"NO-SQL rows={df.toArrow().num_rows}"
        except Exception as exc:  # noqa: BLE001
            message = f"ERROR {type(exc).__name__}: {str(exc)[:900]}"
        ok = message == "" or message.startswith("NO-SQL")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:34s} {time.time() - t0:6.2f}s {message}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
