"""Semi joins, enrichment, merges, site flags and overrides."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from creditloom.functions import dates
from creditloom.operators import balances, clean, joins, ratings, region, reshape, status, tenure
from workload.queries.scans import status_ctes
from workload.registry import as_double, as_money, query

c = F.col
D = dt.date

REGIONS = "'A2A', 'K6A', 'P1A'"


@query(
    "semi_ever_in_region",
    f"""
    SELECT o_orderkey, o_custkey, o_totalprice FROM {{orders}}
    WHERE EXISTS (SELECT 1 FROM {{consumer_month}} AS cm WHERE cm.tu_consumer_id = o_custkey AND cm.fsa IN ({REGIONS}))
    """,
)
def semi_ever_in_region(inp):
    panel = inp("consumer_month")
    members = panel.where(c("fsa").isin("A2A", "K6A", "P1A")).select(
        c("tu_consumer_id").alias("o_custkey")
    )
    orders = inp("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.keep_ever(orders, "o_custkey", members.distinct())


@query(
    "semi_in_subquery",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM {orders}
    WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')
    """,
)
def semi_in_subquery(inp):
    return inp.sql(
        "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_custkey IN "
        "(SELECT DISTINCT c_custkey FROM {customer} WHERE c_mktsegment = 'MACHINERY')"
    )


@query(
    "flag_ever",
    """
    SELECT t.trade_id, t.run_date, t.loc,
      CAST(t.trade_id IN (SELECT s.trade_id FROM {trade_day} AS s WHERE s.closed_indic = 'Y' AND s.mop = '4') AS INT) AS ever
    FROM {trade_day} AS t
    """,
)
def flag_ever(inp):
    flagged = joins.flag_ever(
        inp("trade_day"), "trade_id", (c("closed_indic") == "Y") & (c("mop") == "4"), "ever"
    )
    return flagged.select("trade_id", "run_date", "loc", "ever")


SEEN_CUSTOMERS = """
SELECT o_custkey AS c_custkey, CAST(o_orderdate AS DATE) AS run_date, COUNT(*) AS n_orders
FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1, 2
"""
ALL_DAYS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_custkey END AS c_custkey,
  CAST(o_orderdate AS DATE) AS run_date FROM {orders}
"""


@query(
    "enrich_left",
    f"""
    WITH days AS ({ALL_DAYS}), dim AS ({SEEN_CUSTOMERS})
    SELECT days.o_orderkey, days.c_custkey, days.run_date, dim.n_orders
    FROM days LEFT JOIN dim ON days.c_custkey = dim.c_custkey AND days.run_date = dim.run_date
    """,
)
def enrich_left(inp):
    return joins.enrich(inp.sql(ALL_DAYS), inp.sql(SEEN_CUSTOMERS), ["c_custkey", "run_date"])


@query(
    "enrich_inner_validate",
    """
    SELECT c_custkey, c_nationkey, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey <> 2
    """,
)
def enrich_inner_validate(inp):
    valid = inp("nation").where(c("n_regionkey") != 2).select(
        c("n_nationkey").alias("c_nationkey"), "n_name"
    )
    customers = inp("customer").select("c_custkey", "c_nationkey")
    return joins.enrich(customers, valid, ["c_nationkey"], how="inner")


KEYS = "SELECT s_suppkey % 60 AS enc, min(s_name) AS ldu, COUNT(*) AS n_repeat FROM {supplier} GROUP BY 1"
CODED = "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 80 END AS enc FROM {customer}"


@query(
    "key_translate",
    f"""
    WITH coded AS ({CODED}), keymap AS ({KEYS})
    SELECT c_custkey, coded.enc, ldu FROM coded LEFT JOIN (SELECT * FROM keymap WHERE n_repeat < 2) AS k ON coded.enc = k.enc
    """,
)
def key_translate(inp):
    return joins.translate_key(inp.sql(CODED), inp.sql(KEYS), "enc", "ldu", "n_repeat")


@query(
    "same_month_join",
    """
    SELECT tu_consumer_id, run_date, n_ml, o_orderkey FROM {consumer_month} AS cm
    LEFT JOIN {orders} AS o ON o_custkey = tu_consumer_id
      AND year(run_date) = year(o_orderdate) AND month(run_date) = month(o_orderdate)
    """,
)
def same_month_join(inp):
    facts = inp("orders").select(
        c("o_custkey").alias("tu_consumer_id"), c("o_orderdate").cast("date").alias("day"), "o_orderkey"
    )
    panel = inp("consumer_month").select("tu_consumer_id", "run_date", "n_ml")
    return joins.join_same_month(panel, "run_date", facts, "day", ["tu_consumer_id"])


CARDS = """
SELECT tu_consumer_id, run_date, CASE WHEN tu_consumer_id % 8 = 0 THEN NULL ELSE fsa END AS fsa, 'card' AS src, ml_bal
FROM {consumer_month} AS cm
"""
# Two thirds of the lines are a month late, so that both sides have rows without a match.
LINES = """
SELECT tu_consumer_id, CASE WHEN tu_consumer_id % 3 = 0 THEN run_date ELSE CAST(run_date + INTERVAL 1 MONTH AS DATE) END AS run_date,
  CASE WHEN tu_consumer_id % 8 = 0 THEN NULL ELSE fsa END AS fsa, 'line' AS src, ml_bal_arr AS heloc_bal
FROM {consumer_month} AS cm
"""


@query(
    "full_outer_merge",
    f"""
    WITH a AS ({CARDS}), b AS ({LINES})
    SELECT coalesce(a.tu_consumer_id, b.tu_consumer_id) AS tu_consumer_id, coalesce(a.run_date, b.run_date) AS run_date,
      coalesce(a.fsa, b.fsa) AS fsa, coalesce(a.src, b.src) AS src, coalesce(ml_bal, 0) AS ml_bal, coalesce(heloc_bal, 0) AS heloc_bal
    FROM a FULL JOIN b ON a.tu_consumer_id = b.tu_consumer_id AND a.run_date = b.run_date AND a.fsa = b.fsa
    """,
)
def full_outer_merge(inp):
    return joins.full_merge(
        inp.sql(CARDS), inp.sql(LINES), ["tu_consumer_id", "run_date", "fsa"], ["src"]
    )


@query(
    "site_flag",
    """
    SELECT s_suppkey, s_nationkey, CAST(s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1) AS INT) AS fm_damage
    FROM {supplier}
    """,
)
def site_flag(inp):
    sites = inp("nation").where(c("n_regionkey") == 1).select(c("n_nationkey").alias("s_nationkey"))
    return joins.flag_sites(
        inp("supplier").select("s_suppkey", "s_nationkey"), sites, ["s_nationkey"], "fm_damage"
    )


@query(
    "address_override",
    """
    WITH cohort AS (SELECT trade_id, loc, mop FROM {trade_day} AS t WHERE run_date = DATE '2024-01-10' AND loc = 'view')
    SELECT t.trade_id, t.run_date, CAST(cohort.trade_id IS NOT NULL AS INT) AS treated_ind,
      t.loc AS loc_reported, t.mop AS mop_reported,
      CASE WHEN cohort.trade_id IS NOT NULL AND t.loc <> 'view' AND t.run_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'
           THEN cohort.loc ELSE t.loc END AS loc,
      CASE WHEN cohort.trade_id IS NOT NULL AND t.loc <> 'view' AND t.run_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'
           THEN cohort.mop ELSE t.mop END AS mop
    FROM {trade_day} AS t LEFT JOIN cohort ON cohort.trade_id = t.trade_id
    """,
)
def address_override(inp):
    return joins.address_override(
        inp("trade_day").select("trade_id", "run_date", "loc", "mop"),
        "trade_id", "run_date", ["loc", "mop"],
        anchor=c("run_date") == F.lit(D(2024, 1, 10)),
        inside=c("loc") == "view",
        window=(F.lit(D(2024, 1, 10)), F.lit(D(2024, 1, 15))),
        flag="treated_ind",
    )


GROUPS = """
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS run_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(floor(o_custkey / 10) AS BIGINT) END AS joint_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS holder
FROM {orders}
"""


@query(
    "joint_holder_count",
    f"""
    WITH src AS ({GROUPS}), sizes AS (SELECT run_date, joint_id, COUNT(holder) AS n_now FROM src GROUP BY 1, 2)
    SELECT o_orderkey, src.run_date, src.joint_id, n_now
    FROM src LEFT JOIN sizes ON sizes.run_date = src.run_date AND sizes.joint_id = src.joint_id
    """,
)
def joint_holder_count(inp):
    sized = status.with_group_size(inp.sql(GROUPS), ["run_date", "joint_id"], "holder", "n_now")
    return sized.drop("holder")


@query(
    "having_ever",
    """
    SELECT l_orderkey AS trade_id FROM {lineitem} GROUP BY l_orderkey
    HAVING max(l_extendedprice) >= 80000 OR bool_or(l_returnflag = 'R' AND l_linenumber = 7)
    """,
)
def having_ever(inp):
    lines = inp("lineitem").withColumnRenamed("l_orderkey", "trade_id")
    return balances.having_ever(
        lines,
        "trade_id",
        c("l_extendedprice") >= 80000,
        (c("l_returnflag") == "R") & (c("l_linenumber") == 7),
    )


@query(
    "first_location",
    """
    WITH known AS (SELECT trade_id, run_date, loc, mop FROM {trade_day} AS t WHERE loc <> 'click' AND mop <> '1'),
    firsts AS (SELECT trade_id, min(run_date) AS first_date FROM known GROUP BY trade_id)
    SELECT t.trade_id, t.run_date, k.loc AS loc_loan, k.mop AS mop_loan FROM {trade_day} AS t
    LEFT JOIN firsts ON firsts.trade_id = t.trade_id
    LEFT JOIN known AS k ON k.trade_id = firsts.trade_id AND k.run_date = firsts.first_date
    """,
)
def first_location(inp):
    # Unknown locations are NULL, as after a left join.
    rows = inp("trade_day").select(
        "trade_id",
        "run_date",
        F.when(c("loc") != "click", c("loc")).alias("loc"),
        F.when(c("mop") != "1", c("mop")).alias("mop"),
    )
    out = ratings.attach_first_location(
        rows, "trade_id", "run_date", ["loc", "mop"], ["loc", "mop"], "_loan"
    )
    return out.select("trade_id", "run_date", "loc_loan", "mop_loan")


OWNERS = """
SELECT tu_consumer_id, run_date, fsa, concat('L', CAST(n_ml AS STRING)) AS ldu,
  CASE WHEN tu_consumer_id % 6 = 0 THEN NULL WHEN tu_consumer_id % 2 = 0 THEN 0 ELSE ml_bal_arr END AS ml_bal_crc
FROM {consumer_month} AS cm
"""
MORTGAGES = """
SELECT o_custkey AS tu_consumer_id, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS INT) AS active_mrtg,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS opened,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS closed,
  CAST(o_orderdate AS DATE) AS since
FROM {orders}
"""


@query(
    "homeowner_inference",
    f"""
    WITH crc AS ({OWNERS}), loans AS ({MORTGAGES}),
    opened AS (SELECT DISTINCT l.tu_consumer_id, fsa, ldu FROM loans AS l JOIN crc ON crc.tu_consumer_id = l.tu_consumer_id
      AND crc.run_date = date_trunc('month', opened + INTERVAL 12 MONTH) WHERE active_mrtg = 0),
    closed AS (SELECT DISTINCT l.tu_consumer_id, fsa, ldu FROM loans AS l JOIN crc ON crc.tu_consumer_id = l.tu_consumer_id
      AND crc.run_date = date_trunc('month', closed - INTERVAL 12 MONTH) WHERE active_mrtg = 0),
    active AS (SELECT DISTINCT l.tu_consumer_id, fsa, ldu FROM loans AS l JOIN crc ON crc.tu_consumer_id = l.tu_consumer_id
      AND crc.run_date = date_trunc('month', since + INTERVAL 1 MONTH) WHERE active_mrtg = 1),
    counted AS (SELECT tu_consumer_id, since AS run_date, COUNT(*) AS n_all_mrtg FROM loans GROUP BY 1, 2)
    SELECT crc.tu_consumer_id, crc.run_date, crc.fsa, crc.ldu,
      CASE WHEN ml_bal_crc > 0 THEN 1 WHEN ml_bal_crc = 0 AND (o.fsa IS NOT NULL OR x.fsa IS NOT NULL OR a.fsa IS NOT NULL)
           THEN 1 ELSE 0 END AS homeowner_mrtg,
      n_all_mrtg,
      CASE WHEN n_all_mrtg IS NULL AND (ml_bal_crc > 0 OR ml_bal_crc = 0 AND (o.fsa IS NOT NULL OR x.fsa IS NOT NULL OR a.fsa IS NOT NULL))
           THEN 'Y' ELSE 'N' END AS mrtg_null_refine
    FROM crc
    LEFT JOIN opened AS o ON o.tu_consumer_id = crc.tu_consumer_id AND o.fsa = crc.fsa AND o.ldu = crc.ldu
    LEFT JOIN closed AS x ON x.tu_consumer_id = crc.tu_consumer_id AND x.fsa = crc.fsa AND x.ldu = crc.ldu
    LEFT JOIN active AS a ON a.tu_consumer_id = crc.tu_consumer_id AND a.fsa = crc.fsa AND a.ldu = crc.ldu
    LEFT JOIN counted ON counted.tu_consumer_id = crc.tu_consumer_id AND counted.run_date = crc.run_date
    """,
)
def homeowner_inference(inp):
    rows, loans = inp.sql(OWNERS), inp.sql(MORTGAGES)
    anchors = tenure.loan_anchors(loans, "tu_consumer_id", "opened", "closed", "since", "active_mrtg")
    counts = loans.groupBy("tu_consumer_id", c("since").alias("run_date")).agg(
        F.count(F.lit(1)).alias("n_all_mrtg")
    )
    out = tenure.homeowner_inference(
        rows, rows, anchors, "tu_consumer_id", "run_date", ["fsa", "ldu"], "ml_bal_crc", counts
    )
    return out.select(
        "tu_consumer_id", "run_date", "fsa", "ldu", "homeowner_mrtg", "n_all_mrtg", "mrtg_null_refine"
    )
