"""Stand-in inputs derived from the driver's tables, as SQL both engines run unchanged.

``{table}`` marks a driver table, ``{view}`` another view of this module.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _text(months: str, day: str) -> str:
    """YYYYMMDD text of a date given as running month number and day."""
    return (
        f"CAST(CAST(floor(({months}) / 12) AS BIGINT) * 10000"
        f" + (({months}) % 12 + 1) * 100 + ({day}) AS STRING)"
    )


VIEWS: dict[str, str] = {}

VIEWS["consumer_month"] = """
SELECT o_custkey AS tu_consumer_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date,
  concat(substr('ABCEGHJKLMNPRSTVXY', CAST(c_nationkey % 18 AS INT) + 1, 1), CAST(c_nationkey % 10 AS STRING), 'A') AS fsa,
  CAST(floor(300 + (c_acctbal + 1000) / 18) AS INT) AS cvsc100,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ml_bal,
  CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS ml_bal_arr,
  COUNT(*) AS n_ml
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4
"""

VIEWS["trade_day"] = """
SELECT user_id AS trade_id, CAST(ts AS DATE) AS run_date,
  CAST(ts AS DATE) - CAST(COUNT(*) % 4 AS INT) AS reported_date,
  CAST(SUM(CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS current_balance,
  MAX(value) AS credit_limit,
  CAST(SUM(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS chargoff_amt,
  CASE WHEN MAX(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 THEN 'Y' ELSE 'N' END AS closed_indic,
  CAST(COUNT(*) % 10 AS STRING) AS mop, MAX(event_type) AS loc
FROM {events} GROUP BY user_id, CAST(ts AS DATE)
"""

VIEWS["fsa_quarter"] = """
SELECT n_nationkey AS unit_id, n_name AS fsa, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS run_date,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1000000 AS bal_tot,
  100 * CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE)
      / CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS arr_rt,
  COUNT(DISTINCT o_custkey) AS n_active
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2, 3
"""

VIEWS["loan_line"] = """
SELECT l_orderkey AS trade_id, l_linenumber, o_custkey AS consumer_id, CAST(l_shipdate AS DATE) AS run_date,
  CAST(o_orderdate AS DATE) AS opened_date, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

# Thirty event days become the months 2015-01 … 2017-06, so the study's calendar applies as it is.
_MONTH0 = 24180

VIEWS["bureau_consumer"] = f"""
SELECT tu_consumer_id, {_text('m', '1')} AS run_date,
  concat(substr('T9HT9JT9KT2AT5BT0CS4PS7KM5VV6BT1XT3Z', CAST(3 * (k % 12) + 1 AS INT), 3)) AS fsa,
  CASE WHEN tu_consumer_id % 29 = 3 THEN NULL ELSE concat('E', lpad(CAST(k AS STRING), 6, '0')) END AS encrypted_ldu,
  CAST(CASE WHEN tu_consumer_id % 13 = 0 THEN 0 ELSE 20 + (tu_consumer_id * 7) % 150 END AS INT) AS go30,
  CASE WHEN tu_consumer_id % 4 = 0 THEN 'AB' WHEN tu_consumer_id % 4 = 1 THEN 'ON' WHEN tu_consumer_id % 14 = 2 THEN 'SASK' WHEN tu_consumer_id % 14 = 6 THEN 'AB ' ELSE '??' END AS go90,
  CASE WHEN tu_consumer_id % 31 = 5 AND d > 20 THEN 'Y' ELSE 'N' END AS go91,
  CAST(CASE WHEN (tu_consumer_id + d) % 23 = 0 THEN 0 ELSE 450 + cents % 450 END AS INT) AS as115,
  CAST(CASE WHEN (tu_consumer_id + d) % 17 = 0 THEN -8 WHEN (tu_consumer_id + d) % 19 = 0 THEN 0
       ELSE 480 + cents % 400 END AS INT) AS cvsc100,
  CASE WHEN cents % 3 = 0 THEN 0 WHEN cents % 11 = 1 THEN NULL ELSE cents END AS mc33
FROM (
  SELECT tu_consumer_id, d, {_MONTH0} + d - 1 AS m, cents,
    CASE WHEN d > 8 + tu_consumer_id % 20 THEN CAST(floor(tu_consumer_id / 2) AS BIGINT)
         ELSE CAST(floor(tu_consumer_id * 2 / 3) AS BIGINT) END AS k
  FROM (
    SELECT user_id AS tu_consumer_id, CAST(day(ts) AS BIGINT) AS d,
      CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM {{events}} GROUP BY user_id, CAST(day(ts) AS BIGINT)
  ) AS per_month
) AS placed
"""

VIEWS["bureau_account"] = f"""
SELECT tu_consumer_id, tu_trade_id,
  CASE WHEN tu_trade_id % 5 = 0 THEN NULL ELSE CAST(floor(tu_consumer_id / 2) AS BIGINT) * 10 + p END AS joint_account_id,
  CAST(tu_consumer_id % 2 AS INT) AS primary_indicator,
  CASE WHEN p = 0 THEN CASE WHEN tu_consumer_id % 2 = 0 THEN 'M' ELSE 'I' END
       WHEN p = 3 THEN CASE WHEN tu_consumer_id % 9 = 0 THEN 'O' WHEN tu_consumer_id % 11 = 0 THEN 'M' ELSE 'I' END
       ELSE 'R' END AS acct_type,
  CASE p WHEN 0 THEN 'ML' WHEN 1 THEN 'BC' WHEN 2 THEN 'LC'
       ELSE substr('ALSLILILUTPLILLC', CAST(2 * (tu_consumer_id % 8) + 1 AS INT), 2) END AS product_type,
  CASE x % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'H' ELSE NULL END AS best_amt_flag,
  CASE WHEN x % 11 = 0 THEN NULL WHEN x % 13 = 0 THEN 0 ELSE 9000 + (tu_trade_id * 997) % 60000 END AS credit_limit,
  CASE WHEN x % 7 = 0 THEN NULL ELSE 8000 + (tu_trade_id * 991) % 64000 END AS high_credit_amt,
  CASE WHEN x % 23 = 0 THEN 'TC' WHEN x % 29 = 1 THEN 'WO' WHEN tu_trade_id % 37 = 2 THEN 'SB' ELSE NULL END AS narrative_code1,
  CASE WHEN x % 31 = 0 THEN 'TC' WHEN x % 37 = 1 THEN 'WO' WHEN tu_trade_id % 41 = 3 THEN 'SB' ELSE '' END AS narrative_code2,
  CASE WHEN x % 9 = 0 THEN 'Y' WHEN x % 10 = 1 THEN NULL ELSE 'N' END AS closed_indic,
  CASE WHEN x % 8 = 0 THEN 0 WHEN x % 41 = 0 THEN NULL ELSE cents * 2 END AS current_balance,
  CASE WHEN x % 12 = 0 THEN cents * 3 WHEN x % 5 = 0 THEN NULL WHEN x % 17 = 0 THEN cents ELSE 0 END AS chargoff_amt,
  substr('0111111145X78911', CAST(x % 16 + 1 AS INT), 1) AS mop,
  CASE tu_consumer_id % 7 WHEN 0 THEN 'EasyFinancial' WHEN 1 THEN 'National Money Mart' ELSE 'BNS' END AS l3,
  CAST((tu_consumer_id * 13) % 120 AS INT) AS terms_dur,
  substr('ABDELMPQSTWYRZ', CAST(tu_trade_id % 14 + 1 AS INT), 1) AS terms_frequency,
  CASE WHEN x % 19 = 0 THEN NULL ELSE cents % 2000 END AS terms_amt,
  substr('1X0451179101X0451179101X', CAST(tu_trade_id % 9 + 1 AS INT), 14) AS paymt_pat,
  CAST(d + tu_consumer_id % 3 + CASE WHEN x % 43 = 0 THEN 4 ELSE 0 END AS INT) AS months_reviewed,
  CASE WHEN p = 0 AND x % 6 = 0 THEN 'Y' ELSE 'N' END AS insurance_indicator,
  cents % 500 AS paymt_amt, {_text('m', '1')} AS activity_period,
  lpad(CAST(tu_trade_id % 1000 AS STRING), 6, '4') AS tu_acct_num,
  make_date(CAST(floor(m / 12) AS INT), CAST(m % 12 + 1 AS INT), 1) AS run_date,
  CASE WHEN x % 47 = 0 THEN NULL WHEN x % 53 = 0 THEN '2016BAD1'
       ELSE {_text('m - 1 - (CASE WHEN x % 10 = 3 THEN 1 WHEN x % 10 = 7 THEN 2 ELSE 0 END)',
                   'CASE WHEN x % 6 = 5 THEN 1 ELSE 5 + tu_consumer_id % 20 END')} END AS reported_dt,
  {_text('m - x % 6', '10')} AS last_updated_dt,
  CASE WHEN x % 59 = 0 THEN NULL
       WHEN tu_trade_id % 4 = 0 THEN {_text(f'{_MONTH0} + tu_trade_id % 25', '15')}
       ELSE {_text(f'{_MONTH0} - tu_trade_id % 130', '15')} END AS opened_dt,
  CASE WHEN x % 9 = 0 THEN {_text('m - 1', '20')} ELSE NULL END AS closed_dt,
  CASE WHEN tu_trade_id % 6 = 0 THEN NULL ELSE {_text(f'{_MONTH0} + tu_trade_id % 20', '3')} END AS file_since_dt,
  {_text('m - 1', '7')} AS last_paymt_dt
FROM (
  SELECT tu_consumer_id, p, d, {_MONTH0} + d - 1 AS m, tu_consumer_id * 10 + p AS tu_trade_id, cents,
    tu_consumer_id * 10 + p + d * 7 + cents AS x
  FROM (
    SELECT user_id AS tu_consumer_id,
      CAST(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 0 END AS BIGINT) AS p,
      CAST(day(ts) AS BIGINT) AS d, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM {{events}} GROUP BY 1, 2, 3
  ) AS per_month
) AS keyed
"""

VIEWS["bureau_geo"] = """
SELECT concat(substr('T9HT9JT9KT2AT5BT0CS4PS7KM5VV6BT1XT3Z', CAST(3 * (s_suppkey % 12) + 1 AS INT), 3), ' ',
    lpad(CAST(s_suppkey AS STRING), 6, '0')) AS pstlcode,
  CASE WHEN s_suppkey % 12 IN (6, 7) THEN 'Saskatchewan' WHEN s_suppkey % 12 = 8 THEN 'Ontario'
       WHEN s_suppkey % 12 = 9 THEN 'British Columbia' ELSE 'Alberta' END AS province,
  CAST(CASE WHEN s_suppkey % 12 < 3 THEN 5660 + (s_suppkey % 10) * 2 ELSE 4900 + s_suppkey * 37 % 800 END AS DOUBLE) / 100 AS latitude,
  CAST(CASE WHEN s_suppkey % 12 < 3 THEN -11150 + (s_suppkey % 7) * 3 ELSE -12000 + s_suppkey * 53 % 1700 END AS DOUBLE) / 100 AS longitude
FROM {supplier}
"""

VIEWS["bureau_mapping"] = """
SELECT concat('E', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS encrypted_ldu,
  lpad(CAST(s_suppkey AS STRING), 6, '0') AS ldu,
  CAST(CASE WHEN s_suppkey % 33 = 20 THEN 2 ELSE 1 END AS INT) AS n_repeat
FROM {supplier}
"""

VIEWS["bureau_damaged"] = """
SELECT substr(pstlcode, 1, 3) AS fsa, substr(pstlcode, 5, 6) AS ldu
FROM {bureau_geo} AS geo WHERE substr(pstlcode, 1, 2) = 'T9' AND CAST(substr(pstlcode, 10, 1) AS INT) < 4
"""

# Consumer months with all product blocks, in whole currency units.
VIEWS["individual_month"] = """
SELECT tu_consumer_id, run_date, fsa, treated, CAST(CASE WHEN treated = 1 THEN tu_consumer_id % 2 ELSE 0 END AS INT) AS fm_damage,
  CASE WHEN tu_consumer_id % 17 = 0 THEN 0 ELSE cvsc100 END AS cvsc100,
  CAST(CASE WHEN a % 5 = 0 THEN 0 ELSE 1 END AS INT) AS ml_exist,
  a AS ml_bal, b AS ml_bal_arr, a % 700 AS ml_bal_def, a % 90 AS ml_chargoff_new,
  CASE WHEN a % 3 = 0 THEN 0 ELSE a END AS ml_bal_ins, CASE WHEN a % 3 = 0 THEN 0 ELSE b END AS ml_bal_arr_ins,
  a % 70 AS ml_bal_def_ins, a % 9 AS ml_chargoff_new_ins,
  a % 50000 AS heloc_bal, a % 600 AS heloc_bal_arr, a % 60 AS heloc_bal_def, a % 6 AS heloc_chargoff_new,
  a % 4000 AS bc_bal, a % 400 AS bc_bal_arr, a % 40 AS bc_bal_def, a % 4 AS bc_chargoff_new,
  CASE WHEN a % 7 = 0 THEN 0 ELSE 4999 END AS bc_lmt,
  a % 3000 AS other_bal, a % 300 AS other_bal_arr, a % 30 AS other_bal_def, a % 3 AS other_chargoff_new
FROM (
  SELECT tu_consumer_id, run_date, fsa, cvsc100, CAST(round(ml_bal) AS BIGINT) AS a, CAST(round(ml_bal_arr) AS BIGINT) AS b,
    CAST(CASE WHEN substr(fsa, 1, 1) IN ('A', 'K') THEN 1 ELSE 0 END AS INT) AS treated
  FROM {consumer_month} AS cm
) AS whole
"""

_NAME = re.compile(r"\{(\w+)\}")


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{name: view(spark, sf_dir, name) for name in needs(text)})


def oracle(body: str) -> str:
    """Stand-alone SQL: the views the body needs become leading CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for inner in needs(VIEWS[name]):
            visit(inner)
        ordered.append(name)

    for name in needs(body):
        visit(name)
    ctes = ",\n".join(f"{name} AS ({_NAME.sub(r'\1', VIEWS[name]).strip()})" for name in ordered)
    text = _NAME.sub(r"\1", body).strip()
    if not ordered:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{text[len('WITH RECURSIVE'):].strip()}"
    if text.upper().startswith("WITH"):
        return f"WITH {ctes},\n{text[len('WITH'):].strip()}"
    return f"WITH {ctes}\n{text}"
