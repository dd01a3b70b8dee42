"""Run registered queries against their DuckDB check SQL.

    python -m tests.check_oracle [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import __spark_entry__ as entry_module
from lanewright.plans.bindings import BASE_TABLES
from lanewright.session import local_session


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "~"
        return repr(value + 0.0) if value != int(value) else repr(float(int(value)))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, key, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if sql is None:
        return ("rows" if got else "EMPTY"), len(got), spent, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), spent, f"{sorted(df.columns)} vs {sorted(names)}"
    types = {d[0]: str(d[1]) for d in cur.description}
    odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema.fields
           if not _same_kind(f.dataType.simpleString(), types[f.name])]
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return "DIFF", len(got), spent, f"rows {len(got)} vs {len(want)} first {diff}"
    if odd:
        return "TYPES", len(got), spent, str(odd)
    return ("ok" if got else "EMPTY"), len(got), spent, ""


def _same_kind(spark_type: str, duck_type: str) -> bool:
    kinds = {
        "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE",
    }
    return kinds.get(spark_type, spark_type).lower() in duck_type.lower() or duck_type == "NUMBER"


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    picks = argv[1:] or list(queries)
    bad = 0
    total = 0.0
    for key in picks:
        try:
            status, n, spent, note = compare(spark, con, sf_dir, key, queries[key], oracle.get(key))
        except Exception as error:  # report and go on with the next query
            status, n, spent, note = "ERROR", 0, 0.0, str(error)[:700]
        total += spent
        if status not in ("ok", "rows"):
            bad += 1
        print(f"{status:8} {key:28} {n:7} {spent:6.2f}s {note}", flush=True)
    print(f"{len(picks)} queries, {bad} bad, {total:.1f}s in Spark")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
