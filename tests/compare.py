"""Run queries and their check SQL side by side: ``python -m tests.compare [--sf 0.01] [names...]``."""

from __future__ import annotations

import argparse
import datetime
import glob
import os
import time

import duckdb

from __spark_entry__ import oracle_sql, queries
from trailmark.session import get_session

DATA = "/root/testdata"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, datetime.datetime):
        return v.date().isoformat() if v.time() == datetime.time() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float) and v != v:
        return None
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__ in ("int", "float")), str(v)) for v in row)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql) -> list[str]:
    """Differences between a Spark result and the SQL, none if equal."""
    result = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in result.description}
    want_cols, want = normal([d[0] for d in result.description], result.fetchall())
    got_types = {n: SPARK_TYPES.get(t, t) for n, t in df.dtypes}
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    issues = []
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    for c in got_cols:
        if got_types[c] != want_types[c]:
            issues.append(f"type of {c}: {got_types[c]} != {want_types[c]}")
    if len(got) != len(want):
        issues.append(f"rows {len(got)} != {len(want)}")
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        issues.append(f"{len(bad)} rows differ, first {dict(zip(got_cols, bad[0][0]))} != {dict(zip(got_cols, bad[0][1]))}")
    return issues


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"{DATA}/sf{args.sf}"
    spark = get_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = oracle_sql()
    failed = []
    for name, run in queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                issues = compare(df, con, sqls[name])
                state = "ok" if not issues else "DIFF " + "; ".join(issues)
            else:
                state = f"rows-only {df.count()}"
        except Exception as e:  # noqa: BLE001
            state = "ERROR " + str(e)[:600].replace("\n", " ")
        if state.startswith(("DIFF", "ERROR")):
            failed.append(name)
        print(f"{name:34s} {time.time() - t0:6.2f}s {state}", flush=True)
    print("missing queries:", sorted(set(sqls) - set(queries())))
    print("failed:", failed)


if __name__ == "__main__":
    main()
