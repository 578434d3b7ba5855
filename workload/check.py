"""Run registered queries against their SQL on one scale factor: python -m workload.check [names…]"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

from creditloom.session import build_session
from workload import views

SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "double": "DOUBLE",
}


def _cell(value, digits: int):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.{digits}g}")
    return value


def rows_of(rows, order, digits: int = 17) -> Counter:
    return Counter(tuple(_cell(row[i], digits) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    from workload import registry

    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    spent = time.time() - start
    if name not in registry.ORACLES:
        return f"rows-only  {len(got):>7} rows {spent:6.2f}s"
    rel = con.sql(registry.ORACLES[name])
    want = rel.fetchall()
    types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    mine = {f.name: SAME_TYPE.get(f.dataType.simpleString(), "?") for f in df.schema.fields}
    if types != mine:
        only = {k: (mine.get(k), types.get(k)) for k in {*mine, *types} if mine.get(k) != types.get(k)}
        return f"TYPES      {only}"
    names = sorted(df.columns)
    a_idx = [df.columns.index(c) for c in names]
    b_idx = [rel.columns.index(c) for c in names]
    if rows_of(got, a_idx) == rows_of(want, b_idx):
        verdict = "equal" if got else "EMPTY"
        return f"{verdict}      {len(got):>7} rows {spent:6.2f}s"
    a, b = rows_of(got, a_idx, 9), rows_of(want, b_idx, 9)
    if a == b:
        return f"~9 digits  {len(got):>7} rows {spent:6.2f}s"
    lines = [f"DIFF       {len(got)} vs {len(want)}; columns {names}"]
    key = lambda row: tuple(str(x) for x in row)
    lines += [f"    spark only: {x}" for x in sorted((a - b), key=key)[:3]]
    lines += [f"    sql only:   {x}" for x in sorted((b - a), key=key)[:3]]
    return "\n".join(lines)


def main(argv: list[str]) -> int:
    import workload.queries  # noqa: F401
    from workload import registry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", 8)
    con = duckdb.connect()
    for name in views.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    bad = 0
    for name in argv or sorted(registry.QUERIES):
        try:
            out = compare(spark, con, name, sf_dir)
        except Exception as error:  # keep going: one report over all queries
            out = f"ERROR      {type(error).__name__}: {str(error)[:1500]}"
        bad += not out.startswith(("equal", "rows-only", "~9"))
        print(f"{name:28s} {out}", flush=True)
    print(f"{bad} not equal")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
