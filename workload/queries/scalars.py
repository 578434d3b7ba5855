"""Scalar rules, one query per rule family."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.functions import credit, dates, geo
from creditloom.operators import joins, spatial
from workload.registry import query, r

c = F.col

LIMITS = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS balance,
  CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'H' ELSE NULL END AS flag,
  CASE WHEN l_linenumber = 5 THEN NULL WHEN l_linenumber = 6 THEN 0 ELSE l_quantity * 1500 END AS lim,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 1400 END AS high
FROM {lineitem}
"""


@query(
    "credit_limit_refine",
    f"""
    WITH src AS ({LIMITS}), named AS (
      SELECT *, CASE flag WHEN 'C' THEN lim WHEN 'H' THEN high END AS named_limit FROM src)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN flag IS NULL THEN greatest(coalesce(lim, 0), coalesce(high, 0), balance)
           WHEN balance / nullif(named_limit, 0) < CAST(1.1 AS DOUBLE) THEN named_limit ELSE balance END AS cr_lmt,
      named_limit AS cr_lmt_woadj
    FROM named
    """,
)
def credit_limit_refine(inp):
    src = inp.sql(LIMITS)
    return src.select(
        "l_orderkey",
        "l_linenumber",
        credit.credit_limit(c("flag"), c("lim"), c("high"), c("balance")).alias("cr_lmt"),
        credit.credit_limit_raw(c("flag"), c("lim"), c("high")).alias("cr_lmt_woadj"),
    )


CHARGES = """
SELECT l_orderkey, l_linenumber, l_extendedprice AS balance,
  CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'TC' WHEN l_returnflag = 'A' THEN 'WO' ELSE NULL END AS code1,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'WO' WHEN l_linenumber = 7 THEN NULL ELSE '' END AS code2,
  CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN NULL ELSE l_quantity * 1200 END AS amount
FROM {lineitem}
"""


@query(
    "chargeoff_refine",
    f"""
    WITH src AS ({CHARGES})
    SELECT l_orderkey, l_linenumber,
      CASE WHEN coalesce(code1, '') = 'TC' OR coalesce(code2, '') = 'TC' THEN balance
           WHEN (coalesce(code1, '') = 'WO' OR coalesce(code2, '') = 'WO') AND coalesce(amount, 0) = 0 THEN balance
           WHEN coalesce(amount, 0) < balance THEN coalesce(amount, 0) ELSE balance END AS chargoff_refine
    FROM src
    """,
)
def chargeoff_refine(inp):
    src = inp.sql(CHARGES)
    value = credit.chargeoff(c("code1"), c("code2"), c("amount"), c("balance"))
    return src.select("l_orderkey", "l_linenumber", value.alias("chargoff_refine"))


PAYMENTS = """
SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice,
  CASE p_size % 15 WHEN 14 THEN NULL ELSE substr('ABDELMPQRSTWYZ', CAST(p_size % 15 + 1 AS INT), 1) END AS freq
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


@query(
    "payment_normalise",
    f"""
    WITH src AS ({PAYMENTS}), factors(code, per_month) AS (VALUES
      ('A', CAST(1 AS DOUBLE) / 12), ('B', CAST(2.16 AS DOUBLE)), ('D', CAST(0 AS DOUBLE)), ('E', CAST(2 AS DOUBLE)),
      ('L', CAST(1 AS DOUBLE) / 2), ('M', CAST(1 AS DOUBLE)), ('P', CAST(0 AS DOUBLE)), ('Q', CAST(1 AS DOUBLE) / 3),
      ('R', CAST(1 AS DOUBLE) / 4), ('S', CAST(1 AS DOUBLE) / 6), ('T', CAST(1 AS DOUBLE) / 3),
      ('W', CAST(4.33 AS DOUBLE)), ('Y', CAST(1 AS DOUBLE) / 12))
    SELECT l_orderkey, l_linenumber, freq, p_retailprice * coalesce(per_month, 1) AS terms_pay
    FROM src LEFT JOIN factors ON freq = code
    """,
)
def payment_normalise(inp):
    src = inp.sql(PAYMENTS)
    pay = credit.monthly_payment(c("freq"), c("p_retailprice"))
    return src.select("l_orderkey", "l_linenumber", "freq", pay.alias("terms_pay"))


DATE_TEXT = """
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 'unknown'
    WHEN o_orderkey % 51 = 0 THEN concat(CAST(year(o_orderdate) AS STRING), '1340')
    WHEN o_orderkey % 53 = 0 THEN NULL
    ELSE CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS STRING) END AS txt
FROM {orders}
"""


@query(
    "parse_compact_dates",
    f"""
    WITH src AS ({DATE_TEXT})
    SELECT o_orderkey, CAST(try_strptime(substr(txt, 1, 8), '%Y%m%d') AS DATE) AS full_date,
      CAST(try_strptime(concat(substr(txt, 1, 6), '01'), '%Y%m%d') AS DATE) AS month_date
    FROM src
    """,
)
def parse_compact_dates(inp):
    src = inp.sql(DATE_TEXT)
    return src.select(
        "o_orderkey",
        dates.ymd_to_date(c("txt")).alias("full_date"),
        dates.ym_to_date(c("txt")).alias("month_date"),
    )


@query(
    "origination_buckets",
    """
    SELECT o_orderkey,
      CAST(CASE WHEN year(o_orderdate) >= 1998 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH
           ELSE date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH END AS DATE) AS opened_qtr,
      CAST(CASE WHEN year(o_orderdate) >= 1998 THEN date_trunc('month', o_orderdate)
           ELSE date_trunc('quarter', o_orderdate) END AS DATE) AS closed_qtr
    FROM {orders}
    """,
)
def origination_buckets(inp):
    day = c("o_orderdate").cast("date")
    return inp("orders").select(
        "o_orderkey",
        dates.opened_bucket(day, 1998).alias("opened_qtr"),
        dates.closed_bucket(day, 1998).alias("closed_qtr"),
    )


FALLBACKS = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS opened,
  CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_shipdate AS DATE) ELSE NULL END AS closed,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS paid,
  CASE WHEN l_returnflag = 'R' THEN 'Y' WHEN l_returnflag = 'A' THEN NULL ELSE 'N' END AS closed_indic,
  CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity > 45 THEN NULL ELSE l_quantity END AS balance,
  CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS since
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""


@query(
    "date_fallbacks",
    f"""
    WITH src AS ({FALLBACKS})
    SELECT l_orderkey, l_linenumber,
      CASE WHEN opened IS NULL THEN CAST(paid - INTERVAL 18 MONTH AS DATE) ELSE opened END AS opened_date,
      CASE WHEN (coalesce(closed_indic, '') = 'Y' OR coalesce(balance, 1) = 0) AND closed IS NULL THEN paid
           ELSE closed END AS closed_date,
      coalesce(since, paid) AS file_since_date
    FROM src
    """,
)
def date_fallbacks(inp):
    closed = dates.closed_or_last_payment(c("closed"), c("paid"), c("closed_indic"), c("balance"))
    return inp.sql(FALLBACKS).select(
        "l_orderkey",
        "l_linenumber",
        dates.opened_or_estimated(c("opened"), c("paid")).alias("opened_date"),
        closed.alias("closed_date"),
        F.coalesce("since", "paid").alias("file_since_date"),
    )


@query(
    "age_normalise",
    """
    SELECT p_partkey, CASE WHEN p_size * 5 - 10 > 120 THEN CAST(p_size * 5 - 10 AS DOUBLE) / 12
      WHEN p_size * 5 - 10 > 0 THEN CAST(p_size * 5 - 10 AS DOUBLE) END AS age FROM {part}
    """,
)
def age_normalise(inp):
    return inp("part").select("p_partkey", credit.normalise_age(c("p_size") * 5 - 10).alias("age"))


PLACES = """
SELECT tu_consumer_id, run_date,
  CASE WHEN tu_consumer_id % 7 = 0 THEN NULL WHEN tu_consumer_id % 11 = 0 THEN concat('Z', substr(fsa, 2, 2)) ELSE fsa END AS fsa,
  CASE tu_consumer_id % 5 WHEN 0 THEN 'AB' WHEN 1 THEN 'XX' WHEN 2 THEN NULL ELSE 'NU' END AS go90
FROM {consumer_month} AS cm
"""


@query(
    "province_from_prefix",
    f"""
    WITH src AS ({PLACES}), letters(letter, code) AS (VALUES ('A','NL'),('B','NS'),('C','PE'),('E','NB'),('G','QC'),
      ('H','QC'),('J','QC'),('K','ON'),('L','ON'),('M','ON'),('N','ON'),('P','ON'),('R','MB'),('S','SK'),('T','AB'),
      ('V','BC'),('X','NT'),('Y','YT'))
    SELECT tu_consumer_id, run_date, CASE WHEN code IS NOT NULL THEN code
      WHEN go90 IN ('ON','QC','NS','NB','MB','BC','PE','SK','AB','NL','NT','YT','NU') THEN go90 END AS prov
    FROM src LEFT JOIN letters ON letter = substr(fsa, 1, 1)
    """,
)
def province_from_prefix(inp):
    prov = credit.province(c("fsa"), c("go90")).alias("prov")
    return inp.sql(PLACES).select("tu_consumer_id", "run_date", prov)


BANDED = """
SELECT CAST(CASE WHEN tu_consumer_id % 13 = 0 THEN NULL WHEN tu_consumer_id % 17 = 0 THEN 0 ELSE cvsc100 END AS INT) AS score,
  tu_consumer_id FROM {consumer_month} AS cm
"""


@query(
    "score_bands",
    f"""
    WITH src AS ({BANDED}), marked AS (
      SELECT tu_consumer_id,
        CASE WHEN score IS NULL OR score <= 0 THEN 'NA' WHEN score < 600 THEN 'subprime' WHEN score < 700 THEN 'near prime'
             WHEN score < 780 THEN 'prime' WHEN score < 830 THEN 'prime plus' ELSE 'super prime' END AS as115_tier,
        CASE WHEN score IS NULL OR score < 300 THEN 'NA' WHEN score < 640 THEN 'subprime' WHEN score < 720 THEN 'near prime'
             WHEN score < 760 THEN 'prime' WHEN score < 800 THEN 'prime plus' ELSE 'super prime' END AS cvsc100_tier
      FROM src)
    SELECT as115_tier, cvsc100_tier, COUNT(*) AS n, COUNT(DISTINCT tu_consumer_id) AS n_consumer
    FROM marked GROUP BY 1, 2
    """,
)
def score_bands(inp):
    marked = inp.sql(BANDED).select(
        "tu_consumer_id",
        credit.band(c("score"), credit.RISK_SCORE_CUTS).alias("as115_tier"),
        credit.band(c("score"), credit.CREDIT_SCORE_CUTS).alias("cvsc100_tier"),
    )
    return marked.groupBy("as115_tier", "cvsc100_tier").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("tu_consumer_id").alias("n_consumer")
    )


CODES = """
SELECT p_partkey, concat(substr('ABCEGHJKLM', CAST(p_partkey % 10 + 1 AS INT), 1), CAST(p_partkey % 9 AS STRING), 'K',
  CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '' ELSE '   ' END, CAST(p_partkey % 7 AS STRING), 'Z',
  CAST(p_size % 10 AS STRING), CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE '' END) AS pstlcode
FROM {part}
"""


@query(
    "postal_split",
    f"""
    WITH src AS ({CODES})
    SELECT p_partkey, substr(replace(pstlcode, ' ', ''), 1, 3) AS fsa, substr(replace(pstlcode, ' ', ''), 4) AS ldu FROM src
    """,
)
def postal_split(inp):
    fsa, ldu = geo.split_postal(c("pstlcode"))
    return inp.sql(CODES).select("p_partkey", fsa.alias("fsa"), ldu.alias("ldu"))


@query(
    "nearest_site_distance",
    """
    SELECT u.pstlcode, round(min(111.045 * degrees(acos(least(CAST(1 AS DOUBLE),
        cos(radians(u.latitude)) * cos(radians(s.latitude)) * cos(radians(u.longitude - s.longitude))
        + sin(radians(u.latitude)) * sin(radians(s.latitude)))))), 4) AS distance_min
    FROM {bureau_geo} AS u CROSS JOIN (SELECT latitude, longitude FROM {bureau_geo} AS g WHERE substr(pstlcode, 1, 2) = 'T9') AS s
    GROUP BY u.pstlcode
    """,
)
def nearest_site_distance(inp):
    units = inp("bureau_geo")
    sites = units.where(c("pstlcode").startswith("T9"))
    near = spatial.min_distance(units, sites)
    return near.select("pstlcode", r(c("distance_min"), 4).alias("distance_min"))


USE = """
SELECT trade_id, run_date, current_balance AS bal, CASE WHEN mop = '4' THEN 0 WHEN mop = '5' THEN NULL
  ELSE floor(credit_limit * 2) END AS lim FROM {trade_day} AS t
"""


@query(
    "utilisation_bins",
    f"""
    WITH src AS ({USE}), used AS (SELECT trade_id, run_date, bal, lim, coalesce(bal / nullif(lim, 0), 0) AS use FROM src)
    SELECT trade_id, run_date, use, CAST(use >= CAST(0.6 AS DOUBLE) AND use < CAST(0.8 AS DOUBLE) AS INT) AS use_60_80,
      CAST(use >= CAST(0.8 AS DOUBLE) AS INT) AS use_80_plus FROM used
    """,
)
def utilisation_bins(inp):
    used = inp.sql(USE).withColumn("use", credit.utilisation(c("bal"), c("lim")))
    return used.select(
        "trade_id",
        "run_date",
        "use",
        credit.in_bin(c("use"), 0.6, 0.8).alias("use_60_80"),
        credit.in_bin(c("use"), 0.8).alias("use_80_plus"),
    )


@query(
    "region_rates",
    """
    SELECT unit_id, run_date, 100 * CAST(n_active AS DOUBLE) / nullif(bal_tot, 0) AS active_rt,
      round(ln(nullif(bal_tot, 0)), 6) AS ln_bal,
      round(CASE WHEN arr_rt > 0 THEN ln(arr_rt) END, 6) AS ln_arr
    FROM {fsa_quarter} AS f
    """,
)
def region_rates(inp):
    return inp("fsa_quarter").select(
        "unit_id",
        "run_date",
        credit.rate_pct(c("n_active"), c("bal_tot")).alias("active_rt"),
        r(credit.safe_log(c("bal_tot"))).alias("ln_bal"),
        r(credit.safe_log(c("arr_rt"))).alias("ln_arr"),
    )


LOANS = """
SELECT l_orderkey, l_linenumber,
  CASE p_size % 8 WHEN 0 THEN 'ML' WHEN 1 THEN 'BC' WHEN 2 THEN 'LC' WHEN 3 THEN 'AL' WHEN 4 THEN 'SL' WHEN 5 THEN 'UT' WHEN 6 THEN 'XX' ELSE 'IL' END AS product,
  CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'I' END AS acct, l_extendedprice AS lim,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_quantity * 3 AS INT) END AS term,
  CASE p_partkey % 6 WHEN 0 THEN 'CITI Financial' WHEN 1 THEN 'EasyFinancial Ltd' WHEN 2 THEN NULL ELSE 'BNS' END AS lender,
  CASE WHEN p_partkey % 5 = 0 THEN 'SB' ELSE NULL END AS code1, CASE WHEN p_partkey % 7 = 0 THEN 'SB' ELSE '' END AS code2,
  p_partkey % 9 = 0 AS is_line
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


@query(
    "product_category",
    f"""
    WITH src AS ({LOANS}), marked AS (
      SELECT *, coalesce(code1, '') = 'SB' OR coalesce(code2, '') = 'SB' AS secured, product = 'IL' AS inst FROM src)
    SELECT l_orderkey, l_linenumber,
      CASE WHEN product = 'LC' AND (is_line OR secured) THEN 'HELOC'
           WHEN product IN ('ML', 'BC', 'LC', 'AL', 'SL') THEN product
           WHEN acct <> 'I' THEN CASE product WHEN 'UT' THEN 'UT' ELSE 'Other' END
           WHEN coalesce(term, 0) > 96 OR (inst AND lim > 65000) THEN 'IL_unusual'
           WHEN coalesce(lender, '') IN ('EasyFinancial', 'CITI Financial', 'National Money Mart') THEN 'h_int_IL'
           WHEN inst AND lim >= 15000 AND lim <= 65000 THEN 'AL_Dcr'
           WHEN inst AND secured THEN 'AL_Dsb' ELSE 'IL' END AS product_cat
    FROM marked
    """,
)
def product_category(inp):
    category = credit.product_category(
        c("product"), c("acct"), c("lim"), c("term"), c("lender"), c("code1"), c("code2"), c("is_line")
    )
    return inp.sql(LOANS).select("l_orderkey", "l_linenumber", category.alias("product_cat"))
