"""Scans, sinks and null handling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructType

from creditloom.functions.dates import DAY
from creditloom.operators import clean, joins, status
from creditloom.session import scratch_path
from creditloom.sources import panels
from workload.registry import as_double, as_money, query

D = dt.date


@query(
    "scan_filter_project",
    """
    SELECT o_orderkey AS trade_id, o_custkey AS consumer_id, o_totalprice AS balance,
      CAST(o_orderdate AS DATE) AS run_date
    FROM {orders}
    WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
      AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '2000-01-01'
    """,
)
def scan_filter_project(inp):
    kept = (
        (F.col("o_orderstatus") == "F")
        & (F.col("o_orderpriority") != "5-LOW")
        & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    )
    columns = [
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_custkey").alias("consumer_id"),
        F.col("o_totalprice").alias("balance"),
        F.col("o_orderdate").cast("date").alias("run_date"),
        "o_orderstatus",
    ]
    scanned = panels.scan_panel(inp.spark, f"{inp.sf_dir}/order[rs]*.parquet", columns, kept)
    return scanned.drop("o_orderstatus")


@query("csv_roundtrip", "SELECT unit_id, fsa, run_date, bal_tot, arr_rt, n_active FROM {fsa_quarter} AS f")
def csv_roundtrip(inp):
    panel = inp("fsa_quarter")
    schema = StructType()
    for name, kind in {
        "unit_id": IntegerType(), "fsa": StringType(), "run_date": DateType(),
        "bal_tot": DoubleType(), "arr_rt": DoubleType(), "n_active": LongType(),
    }.items():
        schema.add(name, kind)
    path = scratch_path(inp.spark, "region-csv")
    panels.save_csv_single(panel.select(*schema.names), path)
    return panels.read_region_panel(inp.spark, path, schema)


@query(
    "shard_union",
    """
    SELECT CAST(year(o_orderdate) AS INT) AS year, COUNT(*) AS n,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM {orders} GROUP BY 1
    """,
)
def shard_union(inp):
    path = scratch_path(inp.spark, "order-shards")
    sharded = inp("orders").withColumn("year", F.year("o_orderdate"))
    panels.save(sharded, path, partition_by=["year"])
    shards = inp.spark.read.parquet(path)
    out = as_money(shards, "o_totalprice").groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    return as_double(out, "total")


STATUS_SQL = """
SELECT n.trade_id, n.run_date, n.reported_date, n.mop, n.loc, n.closed_indic, n.current_balance, n.chargoff_amt,
  n.credit_limit,
  CASE WHEN p.trade_id IS NOT NULL THEN 'exist' WHEN n.reported_date >= n.run_date - 2 THEN 'new' ELSE 'legacy' END AS new_file,
  CASE WHEN n.current_balance = 0 AND n.closed_indic = 'Y' THEN 'PD'
       WHEN n.current_balance > 0 AND n.chargoff_amt >= n.current_balance THEN 'WO'
       WHEN n.current_balance > 0 AND n.closed_indic = 'Y' THEN 'AC' ELSE 'N' END AS terminal,
  CASE WHEN p.trade_id IS NOT NULL AND NOT (p.current_balance > 0 AND p.chargoff_amt >= p.current_balance)
         AND n.current_balance > 0 AND n.chargoff_amt >= n.current_balance
       THEN n.chargoff_amt ELSE 0 END AS chargoff_new
FROM {src} AS n LEFT JOIN {src} AS p ON p.trade_id = n.trade_id AND p.run_date = n.run_date - 1
WHERE (p.trade_id IS NULL OR NOT (p.current_balance = 0 AND n.current_balance = 0 AND p.closed_indic = 'Y'))
"""
# Reported-within-two-days and never-paid-on-arrival rules applied on top of the joined rows.
STATUS_CTE = (
    "joined AS (" + STATUS_SQL + "), "
    "status AS (SELECT * FROM joined WHERE NOT (new_file = 'legacy' AND terminal = 'PD'))"
)


def status_ctes(source: str = "{trade_day}") -> str:
    return STATUS_CTE.replace("{src}", source)


def trade_days(inp):
    return as_money(inp("trade_day"), "current_balance", "chargoff_amt")


def day_status(df):
    return status.prev_period_status(
        df, "trade_id", "run_date", "current_balance", "chargoff_amt", "closed_indic",
        account_type=None, opened="reported_date", step=DAY, opened_within=2,
    )


STATUS_OUT = ["trade_id", "run_date", "new_file", "terminal", "chargoff_new"]


@query(
    "warmup_trim",
    f"""
    WITH late AS (SELECT * FROM {{trade_day}} AS t WHERE run_date >= DATE '2024-01-10'),
    {status_ctes('late')}
    SELECT {', '.join(STATUS_OUT)} FROM status WHERE run_date >= DATE '2024-01-11'
    """,
)
def warmup_trim(inp):
    out = panels.ingest_with_warmup(
        trade_days(inp), "run_date", D(2024, 1, 11), day_status, warmup=1, step=DAY
    )
    return as_double(out.select(*STATUS_OUT), "chargoff_new")


@query("incremental_load", f"WITH {status_ctes()} SELECT {', '.join(STATUS_OUT)} FROM status")
def incremental_load(inp):
    """A few days at a time, one load twice and an old one again: the same rows as one pass over everything."""
    days = trade_days(inp)
    table, state = scratch_path(inp.spark, "loaded"), scratch_path(inp.spark, "state")
    first, last = days.agg(F.min("run_date"), F.max("run_date")).first()
    length = -(-((last - first).days + 1) // 4)
    starts = [first + dt.timedelta(days=length * k) for k in range(4)]
    schema = day_status(days).schema
    for start in [starts[0], starts[1], starts[1], starts[2], starts[0], starts[3]]:
        panels.load_range(days, table, state, "run_date", start, start + dt.timedelta(days=length), day_status, step=DAY)
    return as_double(panels.read_loaded(inp.spark, table, schema).select(*STATUS_OUT), "chargoff_new")


SCORES = """
SELECT c_custkey, c_nationkey,
  CAST(CASE WHEN c_acctbal < -500 THEN -8 WHEN c_acctbal < 0 THEN 0 ELSE floor(c_acctbal / 10) END AS INT) AS cvsc100,
  CAST(CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE c_custkey % 900 END AS INT) AS as115
FROM {customer}
"""


@query(
    "sentinel_to_null",
    f"""
    WITH src AS ({SCORES})
    SELECT c_nationkey, COUNT(*) AS n, COUNT(CASE WHEN cvsc100 NOT IN (0, -8) THEN 1 END) AS n_cvsc100,
      COUNT(nullif(as115, 0)) AS n_as115, CAST(SUM(CASE WHEN cvsc100 > 0 THEN cvsc100 END) AS BIGINT) AS sum_cvsc100
    FROM src GROUP BY c_nationkey
    """,
)
def sentinel_to_null(inp):
    cleaned = clean.sentinel_to_null(inp.sql(SCORES), {"cvsc100": [-8, 0], "as115": [0]})
    return cleaned.groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("cvsc100").alias("n_cvsc100"),
        F.count("as115").alias("n_as115"),
        F.sum("cvsc100").alias("sum_cvsc100"),
    )


def _block(status_code: str) -> str:
    low = status_code.lower()
    return f"""
    SELECT o_custkey AS c_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS {low}_bal,
      COUNT(*) AS {low}_n
    FROM {{orders}} WHERE o_orderstatus = '{status_code}' GROUP BY o_custkey
    """


LINES = """
SELECT o_custkey AS c_custkey, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_qty
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY o_custkey
"""
BASE = """
SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS score FROM {customer}
"""


@query(
    "zero_fill_wide_join",
    f"""
    WITH base AS ({BASE}), f AS ({_block('F')}), o AS ({_block('O')}), p AS ({_block('P')}), l AS ({LINES})
    SELECT base.c_custkey, c_mktsegment, coalesce(score, 0) AS score,
      coalesce(f_bal, 0) AS f_bal, coalesce(f_n, 0) AS f_n, coalesce(o_bal, 0) AS o_bal, coalesce(o_n, 0) AS o_n,
      coalesce(p_bal, 0) AS p_bal, coalesce(p_n, 0) AS p_n, coalesce(l_qty, 0) AS l_qty,
      CAST(f.c_custkey IS NOT NULL AS INT) AS f_exist, CAST(o.c_custkey IS NOT NULL AS INT) AS o_exist,
      CAST(p.c_custkey IS NOT NULL AS INT) AS p_exist, CAST(l.c_custkey IS NOT NULL AS INT) AS l_exist
    FROM base LEFT JOIN f ON base.c_custkey = f.c_custkey LEFT JOIN o ON base.c_custkey = o.c_custkey
      LEFT JOIN p ON base.c_custkey = p.c_custkey LEFT JOIN l ON base.c_custkey = l.c_custkey
    """,
)
def zero_fill_wide_join(inp):
    blocks = {c.lower(): inp.sql(_block(c)) for c in "FOP"} | {"l": inp.sql(LINES)}
    return joins.merge_products(inp.sql(BASE), blocks, ["c_custkey"])


@query(
    "stale_record_filter",
    """
    SELECT trade_id, run_date, reported_date, mop FROM {trade_day} AS t
    WHERE current_balance IS NOT NULL AND credit_limit <> 0
      AND (reported_date >= run_date - 2 OR mop IN ('7', '8', '9'))
    """,
)
def stale_record_filter(inp):
    return clean.clean_trades(
        inp("trade_day"), "run_date", "reported_date", "mop", "current_balance", "credit_limit",
        stale=2, step=DAY,
    ).select("trade_id", "run_date", "reported_date", "mop")


@query(
    "credit_active",
    """
    SELECT run_date, fsa, COUNT(*) AS n FROM {individual_month} AS i
    WHERE ml_bal_arr + bc_lmt + other_bal_def + other_chargoff_new > 0 GROUP BY run_date, fsa
    """,
)
def credit_active(inp):
    parts = ["ml_bal_arr", "bc_lmt", "other_bal_def", "other_chargoff_new"]
    active = clean.credit_active(inp("individual_month"), parts)
    return active.groupBy("run_date", "fsa").agg(F.count(F.lit(1)).alias("n"))


@query(
    "event_window",
    """
    SELECT unit_id, run_date, bal_tot, CAST(run_date <= DATE '1998-04-01' AS INT) AS pre
    FROM {fsa_quarter} AS f WHERE run_date BETWEEN DATE '1996-01-01' AND DATE '2000-01-01'
    """,
)
def event_window(inp):
    from creditloom.operators import synthetic

    spec = synthetic.ScmSpec(
        "arr_rt", "bal_tot", (), (), (D(1996, 1, 1), D(2000, 1, 1)), D(1998, 4, 1)
    )
    rows = synthetic.event_window(inp("fsa_quarter"), "run_date", spec)
    return rows.select("unit_id", "run_date", "bal_tot", "pre")
