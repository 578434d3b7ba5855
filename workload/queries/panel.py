"""Panel operators on the day-spaced account fixture."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from creditloom.functions.dates import DAY, quarter_label
from creditloom.operators import asof, quality, ratings, reshape, tenure
from workload.queries.scans import STATUS_OUT, day_status, status_ctes, trade_days
from workload.registry import as_double, as_money, query, r

c = F.col
D = dt.date


@query(
    "prev_period_status",
    f"WITH {status_ctes()} SELECT {', '.join(STATUS_OUT)} FROM status",
)
def prev_period_status(inp):
    return as_double(day_status(trade_days(inp)).select(*STATUS_OUT), "chargoff_new")


TWICE = """twice AS (
  SELECT * FROM {trade_day} AS t UNION ALL
  SELECT * REPLACE (chargoff_amt + 1 AS chargoff_amt) FROM {trade_day} AS u WHERE mop = '4')"""


@query(
    "prev_period_duplicates",
    f"WITH {TWICE}, {status_ctes('twice')} SELECT {', '.join(STATUS_OUT)} FROM status",
)
def prev_period_duplicates(inp):
    """Repeated (account, period) rows: one row per match, as a join gives."""
    again = inp("trade_day").where(c("mop") == "4").withColumn("chargoff_amt", c("chargoff_amt") + 1)
    rows = as_money(inp("trade_day").union(again), "current_balance", "chargoff_amt")
    return as_double(day_status(rows).select(*STATUS_OUT), "chargoff_new")


REFS = """refs AS (
  SELECT trade_id, reported_date + 1 AS ref_date FROM {src} AS a UNION SELECT trade_id, run_date FROM {src} AS b)"""
LATEST = """latest AS (
  SELECT trade_id, reported_date, max(run_date) AS last_run_date FROM {src} AS a GROUP BY trade_id, reported_date)"""
CHOSEN = """chosen AS (
  SELECT refs.trade_id, refs.ref_date, max(last_run_date) AS select_run_date FROM refs LEFT JOIN latest
  ON latest.trade_id = refs.trade_id AND latest.reported_date BETWEEN refs.ref_date - 3 AND refs.ref_date GROUP BY 1, 2)"""


def on(source: str, *ctes: str) -> str:
    return ", ".join(ctes).replace("{src}", source)


@query("reference_dates", f"WITH {on('{trade_day}', REFS)} SELECT trade_id, ref_date FROM refs")
def reference_dates(inp):
    return asof.reference_dates(inp("trade_day"), "trade_id", "run_date", "reported_date", DAY)


@query("latest_run", f"WITH {on('{trade_day}', LATEST)} SELECT * FROM latest")
def latest_run(inp):
    return asof.latest_run(inp("trade_day"), "trade_id", "run_date", "reported_date")


@query(
    "asof_latest_report",
    f"WITH {on('{trade_day}', REFS, LATEST, CHOSEN)} SELECT trade_id, ref_date, select_run_date FROM chosen",
)
def asof_latest_report(inp):
    return asof.asof_latest_report(
        inp("trade_day"), "trade_id", "run_date", "reported_date", 3, DAY
    )


REBUILT = """
  SELECT chosen.ref_date, s.trade_id, s.run_date, s.reported_date, s.mop, s.terminal, s.loc, s.current_balance
  FROM chosen JOIN status AS s ON s.trade_id = chosen.trade_id AND s.run_date = chosen.select_run_date
  WHERE NOT (chosen.ref_date >= s.reported_date + 1 AND s.terminal = 'PD')"""


def rebuilt_ctes() -> str:
    return f"{status_ctes()}, {on('status', REFS, LATEST, CHOSEN)}, rebuilt AS ({REBUILT})"


def rebuilt_days(inp):
    return asof.rebuild_as_of(
        day_status(trade_days(inp)), "trade_id", "run_date", "reported_date", "terminal", 3, DAY
    )


@query(
    "rebuild_as_of",
    f"WITH {rebuilt_ctes()} SELECT trade_id, ref_date, run_date, mop, terminal, current_balance FROM rebuilt",
)
def rebuild_as_of(inp):
    out = rebuilt_days(inp).select(
        "trade_id", "ref_date", "run_date", "mop", "terminal", "current_balance"
    )
    return as_double(out, "current_balance")


PATTERNED = """
SELECT trade_id, run_date, mop, substr('0123456789X1234567890', CAST(trade_id % 9 + 1 AS INT), 12) AS pattern,
  CAST(day(run_date) + trade_id % 3 + CASE WHEN run_date = DATE '2024-01-14' THEN 8 ELSE 0 END AS INT) AS reviewed
FROM {trade_day} AS t
"""
REVISED = f"""
  src AS ({PATTERNED}), rev AS (SELECT * FROM src WHERE run_date = DATE '2024-01-20'),
  offs AS (SELECT s.*, rev.pattern AS rev_pattern, rev.reviewed - s.reviewed + 1 AS off
    FROM src AS s LEFT JOIN rev ON rev.trade_id = s.trade_id AND s.run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'),
  seen AS (SELECT *, CASE WHEN off = 0 THEN substr(rev_pattern, 1, 1) ELSE substr(rev_pattern, CAST(off AS INT), 1) END AS hist FROM offs),
  revised AS (SELECT trade_id, run_date, mop, CASE WHEN hist IS NULL OR hist = mop THEN mop ELSE hist END AS mop_rev FROM seen)
"""


def revised_days(inp):
    src = inp.sql(PATTERNED)
    facts = ratings.revision_facts(
        src, "trade_id", "run_date", "pattern", "reviewed", D(2024, 1, 20)
    )
    return ratings.revise_from_history(
        src, facts, "trade_id", "run_date", "mop", "reviewed", D(2024, 1, 5), D(2024, 1, 20), "mop_rev"
    )


@query("mop_revise_from_history", f"WITH {REVISED} SELECT trade_id, run_date, mop, mop_rev FROM revised")
def mop_revise_from_history(inp):
    return revised_days(inp).select("trade_id", "run_date", "mop", "mop_rev")


@query(
    "deferral_adjust",
    f"""
    WITH {REVISED}, bad AS (SELECT * FROM revised WHERE trade_id % 3 <> 0 AND NOT regexp_matches(mop_rev, '[X01]')),
    before AS (SELECT DISTINCT trade_id FROM bad WHERE run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-05'),
    after AS (SELECT DISTINCT trade_id FROM bad WHERE run_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-20')
    SELECT v.trade_id, v.run_date, v.mop_rev,
      CASE WHEN v.run_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-17' AND v.trade_id % 3 <> 0
        AND NOT regexp_matches(v.mop_rev, '[X01]')
        AND v.trade_id NOT IN (SELECT trade_id FROM before) AND v.trade_id NOT IN (SELECT trade_id FROM after)
      THEN '1' ELSE v.mop_rev END AS mop_adj
    FROM revised AS v
    """,
)
def deferral_adjust(inp):
    out = ratings.deferral_adjust(
        revised_days(inp), "trade_id", "run_date", "mop_rev", c("trade_id") % 3 != 0,
        (D(2024, 1, 5), D(2024, 1, 5)), (D(2024, 1, 8), D(2024, 1, 17)),
        (D(2024, 1, 19), D(2024, 1, 20)), "mop_adj",
    )
    return out.select("trade_id", "run_date", "mop_rev", "mop_adj")


STAYS = "SELECT trade_id, run_date, CASE WHEN mop = '5' THEN NULL ELSE loc END AS loc FROM {trade_day} AS t"


@query(
    "stay_duration",
    f"""
    WITH src AS ({STAYS})
    SELECT n.trade_id, n.loc, n.run_date,
      CAST(SUM(CASE WHEN p.run_date IS NULL THEN 0 WHEN day(p.run_date) >= 10 THEN 1 ELSE 3 END) AS BIGINT) AS stay_dur,
      CASE WHEN min(p.run_date) = DATE '2024-01-01' THEN 1 ELSE 0 END AS stay_censored
    FROM src AS n LEFT JOIN src AS p ON p.trade_id = n.trade_id AND p.loc = n.loc AND p.run_date < n.run_date
    GROUP BY 1, 2, 3
    """,
)
def stay_duration(inp):
    weight = F.when(F.day("run_date") >= 10, 1).otherwise(3)
    return tenure.stay_duration(
        inp.sql(STAYS), "trade_id", ["loc"], "run_date", weight, D(2024, 1, 1)
    )


@query(
    "spells",
    """
    WITH marked AS (SELECT trade_id, run_date, CASE WHEN lag(run_date) OVER w = run_date - 1 THEN 0 ELSE 1 END AS opens
      FROM {trade_day} AS t WINDOW w AS (PARTITION BY trade_id ORDER BY run_date)),
    numbered AS (SELECT trade_id, run_date, CAST(SUM(opens) OVER (PARTITION BY trade_id ORDER BY run_date) AS INT) AS spell FROM marked),
    runs AS (SELECT trade_id, spell, min(run_date) AS spell_start, max(run_date) AS spell_end, COUNT(*) AS spell_length
      FROM numbered GROUP BY 1, 2)
    SELECT runs.*, CAST(max(spell) OVER (PARTITION BY trade_id) AS BIGINT) AS max_spell FROM runs
    """,
)
def spells(inp):
    return reshape.spells(inp("trade_day"), "trade_id", "run_date", DAY)


ADJUSTED = """
SELECT trade_id, run_date, mop, CASE WHEN mop = '3' THEN 'X' WHEN trade_id % 4 = 0 AND mop = '4' THEN '1' ELSE mop END AS mop_adj
FROM {trade_day} AS t
"""


@query(
    "rating_checks",
    f"""
    WITH src AS ({ADJUSTED})
    SELECT trade_id, max(CASE WHEN mop_adj <> mop THEN 1 ELSE 0 END) AS check_mop,
      max(CASE WHEN run_date = DATE '2024-01-12' AND TRY_CAST(mop_adj AS INT) >= 4 THEN 1 ELSE 0 END) AS check_arr,
      max(CASE WHEN run_date = DATE '2024-01-13' AND TRY_CAST(mop_adj AS INT) < 4 THEN 1 ELSE 0 END) AS check_recover
    FROM src GROUP BY trade_id
    """,
)
def rating_checks(inp):
    return quality.rating_checks(
        inp.sql(ADJUSTED), "trade_id", "run_date", "mop", "mop_adj", D(2024, 1, 12), D(2024, 1, 13)
    )


@query(
    "recovered_accounts",
    f"""
    WITH src AS ({ADJUSTED})
    SELECT trade_id, run_date, mop, mop_adj FROM src WHERE run_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25'
      AND trade_id IN (SELECT trade_id FROM src WHERE run_date = DATE '2024-01-12' AND TRY_CAST(mop_adj AS INT) >= 4)
      AND trade_id IN (SELECT trade_id FROM src WHERE run_date = DATE '2024-01-13' AND TRY_CAST(mop_adj AS INT) < 4)
    """,
)
def recovered_accounts(inp):
    src = inp.sql(ADJUSTED)
    checks = quality.rating_checks(
        src, "trade_id", "run_date", "mop", "mop_adj", D(2024, 1, 12), D(2024, 1, 13)
    )
    return quality.recovered_accounts(
        src, checks, "trade_id", "run_date", (D(2024, 1, 5), D(2024, 1, 25))
    )


@query(
    "cohort_extract",
    """
    SELECT trade_id, run_date, mop, loc FROM {trade_day} AS t
    WHERE trade_id IN (SELECT trade_id FROM {trade_day} AS s WHERE mop = '5' AND loc = 'view')
    """,
)
def cohort_extract(inp):
    rows = inp("trade_day").select("trade_id", "run_date", "mop", "loc")
    return reshape.cohort_extract(rows, "trade_id", (c("mop") == "5") & (c("loc") == "view"))


@query(
    "quarter_means",
    """
    WITH labelled AS (SELECT concat('yr', substr(CAST(year(run_date - INTERVAL 1 MONTH) AS STRING), 3, 2), '_q',
        CAST(quarter(run_date - INTERVAL 1 MONTH) AS STRING)) AS label, fsa, n_ml, cvsc100 FROM {consumer_month} AS cm)
    SELECT label, fsa, CAST(SUM(n_ml) AS DOUBLE) / COUNT(*) AS n_ml_avg, round(avg(cvsc100), 6) AS score_avg
    FROM labelled GROUP BY label, fsa
    """,
)
def quarter_means(inp):
    rows = inp("consumer_month").withColumn("label", quarter_label(c("run_date")))
    return rows.groupBy("label", "fsa").agg(
        F.avg("n_ml").alias("n_ml_avg"), r(F.avg("cvsc100")).alias("score_avg")
    )


@query(
    "index_to_base",
    """
    SELECT f.unit_id, f.run_date, f.bal_tot, f.bal_tot / nullif(b.bal_tot, 0) AS bal_tot_norm FROM {fsa_quarter} AS f
    LEFT JOIN (SELECT unit_id, bal_tot FROM {fsa_quarter} AS g WHERE run_date = DATE '1998-04-01') AS b ON b.unit_id = f.unit_id
    """,
)
def index_to_base(inp):
    rows = inp("fsa_quarter").select("unit_id", "run_date", "bal_tot")
    return reshape.index_to_base(rows, ["unit_id"], "run_date", D(1998, 4, 1), ["bal_tot"])


@query(
    "unit_ids",
    """
    WITH ids AS (SELECT fsa, CAST(row_number() OVER (ORDER BY fsa) AS INT) AS unit_no FROM (SELECT DISTINCT fsa FROM {fsa_quarter} AS f) AS d)
    SELECT f.fsa, unit_no, run_date, CAST(run_date - DATE '1970-01-01' AS INT) AS date_num
    FROM {fsa_quarter} AS f JOIN ids ON ids.fsa = f.fsa
    """,
)
def unit_ids(inp):
    rows = inp("fsa_quarter").select("fsa", "run_date")
    ids = reshape.unit_ids(rows, "fsa", "unit_no")
    return rows.join(ids, "fsa").withColumn("date_num", F.unix_date("run_date"))


WEIGHTED = """
SELECT concat('q', CAST(quarter(run_date) AS STRING)) AS variant, fsa, CAST(SUM(CAST(n_active AS BIGINT)) AS DOUBLE)
  - CASE WHEN unit_id % 4 = 0 THEN 100000 ELSE 0 END AS weight
FROM {fsa_quarter} AS f GROUP BY 1, 2, unit_id
"""


@query(
    "top_k_per_group",
    f"""
    WITH src AS ({WEIGHTED}), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY variant ORDER BY weight DESC, fsa) AS INT) AS rank
      FROM src WHERE weight > 0)
    SELECT variant, fsa, weight, rank FROM ranked WHERE rank <= 5
    """,
)
def top_k_per_group(inp):
    return reshape.top_k_per_group(inp.sql(WEIGHTED), ["variant"], "weight", "fsa", 5)


@query(
    "donor_pool",
    """
    SELECT n_name AS fsa FROM {nation} EXCEPT SELECT n_name FROM {nation} WHERE n_regionkey = 3
    """,
)
def donor_pool(inp):
    units = inp("nation").withColumnRenamed("n_name", "fsa")
    return reshape.donor_pool(units, "fsa", units.where(c("n_regionkey") == 3))


@query(
    "entity_sample",
    f"""
    SELECT trade_id, COUNT(*) AS n FROM {{trade_day}} AS t
    WHERE CAST('0x' || substr(md5(CAST(trade_id AS VARCHAR) || '-1983'), 1, 8) AS BIGINT) < {2**30} GROUP BY trade_id
    """,
)
def entity_sample(inp):
    sampled = reshape.sample_entities(inp("trade_day"), "trade_id", 0.25, 1983)
    return sampled.groupBy("trade_id").agg(F.count(F.lit(1)).alias("n"))
