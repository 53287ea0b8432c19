"""Runs registered queries against their SQL in DuckDB and compares names, types and values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return ("0",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return ("f", round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    if isinstance(value, dt.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, str(value))


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, con, build, sql: str | None, sf_dir: str):
    start = time.time()
    df = build(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"rows only, {len(got)} rows", took
    rel = con.sql(sql)
    want, names, types = rel.fetchall(), rel.columns, [str(t) for t in rel.types]
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(set(df.columns) ^ set(names))}", took
    spark_types = {n: TYPE_NAMES.get(t, t) for n, t in df.dtypes}
    wrong = {n: (spark_types[n], t) for n, t in zip(names, types) if spark_types[n] != t}
    a, b = rows(got, df.columns), rows(want, names)
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return False, f"rows {len(a)} vs {len(b)}; columns {sorted(names)}\n   spark {only_a}\n   sql   {only_b}", took
    if wrong:
        return False, f"types {wrong}", took
    return True, f"{len(a)} rows", took


def main(argv) -> int:
    import __spark_entry__ as entry
    from usagekit import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    shared = tempfile.mkdtemp(prefix="compare-")  # one machine: its own folder is shared enough
    spark = build_session(
        master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": shared}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note, took = compare(spark, con, build, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:700]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
