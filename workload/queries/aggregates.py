"""Balances, region panels and descriptive tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from creditloom.functions import credit
from creditloom.operators import balances, clean, joins, quality, region, reshape
from creditloom.plans import scm_study
from creditloom.plans.study import STUDY
from workload.queries.scans import day_status, status_ctes, trade_days
from workload.registry import as_double, as_money, query, r, rounded

c = F.col
D = dt.date

CENTS = "CAST(current_balance AS DECIMAL(18,2))"
CHARGED = "CAST(chargoff_amt AS DECIMAL(18,2))"
CHARGED_NEW = "CAST(chargoff_new AS DECIMAL(18,2))"


def measures_sql(prefix: str, extra: str = "TRUE", suffix: str = "") -> str:
    """The five conditional sums over rows of a status CTE."""
    def total(test: str, value: str, name: str) -> str:
        return (
            f"CAST(SUM(CASE WHEN {test} AND ({extra}) THEN {value} ELSE 0 END) AS DOUBLE) AS {prefix}_{name}{suffix}"
        )

    return ", ".join(
        [
            total("terminal <> 'WO'", CENTS, "bal"),
            total("terminal <> 'WO' AND mop IN ('4', '5')", CENTS, "bal_arr"),
            total("terminal <> 'WO' AND mop IN ('7', '8', '9')", CENTS, "bal_def"),
            total("terminal = 'WO'", CHARGED, "chargoff"),
            total("terminal = 'WO'", CHARGED_NEW, "chargoff_new"),
        ]
    )


ARGS = ("current_balance", "mop", "terminal", "chargoff_amt", "chargoff_new")


@query(
    "arrears_buckets",
    f"WITH {status_ctes()} SELECT run_date, {measures_sql('ml')} FROM status GROUP BY run_date",
)
def arrears_buckets(inp):
    out = day_status(trade_days(inp)).groupBy("run_date").agg(*balances.balance_measures("ml", *ARGS))
    return as_double(out, *[f"ml_{m}" for m in balances.MEASURES])


@query(
    "insured_balances",
    f"""
    WITH {status_ctes()}, ever AS (SELECT DISTINCT trade_id FROM {{trade_day}} AS t WHERE closed_indic = 'Y' AND mop = '3'),
    flagged AS (SELECT status.*, CAST(ever.trade_id IS NOT NULL AS INT) AS insured FROM status LEFT JOIN ever ON ever.trade_id = status.trade_id)
    SELECT run_date, {measures_sql('ml', 'insured = 1', '_ins')} FROM flagged GROUP BY run_date
    """,
)
def insured_balances(inp):
    flagged = joins.flag_ever(
        trade_days(inp), "trade_id", (c("closed_indic") == "Y") & (c("mop") == "3"), "insured"
    )
    out = day_status(flagged).groupBy("run_date").agg(
        *balances.balance_measures("ml", *ARGS, subset=c("insured") == 1, suffix="_ins")
    )
    return as_double(out, *[f"ml_{m}_ins" for m in balances.MEASURES])


@query(
    "active_limits",
    f"""
    WITH {status_ctes()}, located AS (SELECT *, CASE WHEN mop = '2' THEN NULL ELSE loc END AS place FROM status),
    totals AS (SELECT run_date, place, CAST(SUM(CASE WHEN terminal <> 'WO' THEN {CENTS} ELSE 0 END) AS DOUBLE) AS bc_bal
      FROM located GROUP BY 1, 2),
    actives AS (SELECT run_date, place, COUNT(trade_id) AS n_bc, CAST(SUM(CAST(credit_limit AS DECIMAL(18,2))) AS DOUBLE) AS bc_lmt
      FROM located WHERE terminal NOT IN ('PD', 'WO') AND new_file = 'legacy' OR terminal = 'AC' GROUP BY 1, 2)
    SELECT t.run_date, t.place, bc_bal, n_bc, bc_lmt
    FROM totals AS t LEFT JOIN actives AS a ON a.run_date = t.run_date AND a.place = t.place
    """,
)
def active_limits(inp):
    rows = as_money(day_status(trade_days(inp)), "credit_limit").withColumn(
        "place", F.when(c("mop") != "2", c("loc"))
    )
    # Fewer accounts count as active here, so that some groups have none.
    inactive = ~(
        (~c("terminal").isin("PD", "WO") & (c("new_file") == "legacy")) | (c("terminal") == "AC")
    )
    rows = rows.withColumn("state", F.when(inactive & (c("terminal") != "WO"), "PD").otherwise(c("terminal")))
    out = balances.consumer_loans(
        rows, ["run_date", "place"], "bc", "trade_id", terminal="state", charged="chargoff_amt",
        limit="credit_limit", nullable_keys=["place"],
    )
    return as_double(out.select("run_date", "place", "bc_bal", "n_bc", "bc_lmt"), "bc_bal", "bc_lmt")


@query(
    "rollup_consumer",
    """
    SELECT consumer_id, CAST(date_trunc('month', run_date) AS DATE) AS ref_date,
      CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice
    FROM {loan_line} AS l GROUP BY 1, 2
    """,
)
def rollup_consumer(inp):
    measures = ["l_quantity", "l_extendedprice"]
    lines = as_money(inp("loan_line"), *measures).withColumn("ref_date", F.trunc("run_date", "MM"))
    out = balances.rollup_consumer(lines, ["consumer_id", "ref_date"], measures)
    return as_double(out, *measures)


@query(
    "study_groups",
    """
    WITH marked AS (SELECT tu_consumer_id, run_date, fsa, CAST(substr(fsa, 1, 1) IN ('A', 'B') AS INT) AS treated,
      CASE WHEN substr(fsa, 1, 1) IN ('C', 'E', 'G', 'H') AND cvsc100 / 4.0 >= 100 THEN 1 ELSE 0 END AS control FROM {consumer_month} AS cm)
    SELECT tu_consumer_id, run_date, treated, control, CASE WHEN treated = 1 THEN 'T(A|B)' ELSE fsa END AS fsa
    FROM marked WHERE treated = 1 OR control = 1
    """,
)
def study_groups(inp):
    rows = inp("consumer_month").select(
        "tu_consumer_id", "run_date", "fsa", F.substring("fsa", 1, 1).alias("prov"),
        (c("cvsc100") / 4).alias("distance_min"),
    )
    marked = region.assign_groups(
        rows, "fsa", "^(A|B)", "prov", ["C", "E", "G", "H"], "distance_min", 100.0
    )
    kept = region.group_label(region.keep_study_units(marked), "fsa", "T(A|B)")
    return kept.select("tu_consumer_id", "run_date", "treated", "control", "fsa")


KEYS = "run_date, treated, fm_damage, fsa"
USE = "coalesce(CAST(bc_bal AS DOUBLE) / nullif(bc_lmt, 0), 0)"
USE_NULL = "CAST(bc_bal AS DOUBLE) / nullif(bc_lmt, 0)"
AVG = "CAST(SUM({0}) AS DOUBLE) / COUNT({0})"


def insured_sql(source: str, keys: str = KEYS) -> str:
    """Plain form: the insured subset aggregated on its own."""
    def avg(name: str, value: str) -> str:
        return AVG.format(value) + f" AS {name}"

    def total(name: str, test: str) -> str:
        return f"CAST(SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"

    parts = [
        "COUNT(DISTINCT tu_consumer_id) AS n_ml_ins",
        avg("ml_bal_ins", "ml_bal_ins"), avg("heloc_bal", "heloc_bal"),
        avg("res_bal", "(ml_bal + heloc_bal)"), avg("cl_bal", "other_bal"), avg("bc_bal", "bc_bal"),
        avg("bc_bal_arr", "(bc_bal_arr + bc_bal_def)"), f"round(AVG({USE}), 6) AS bc_use",
        total("n_bc_use_60_80", f"{USE_NULL} >= CAST(0.6 AS DOUBLE) AND {USE_NULL} < CAST(0.8 AS DOUBLE)"),
        total("n_bc_use_80_plus", f"{USE_NULL} >= CAST(0.8 AS DOUBLE)"),
        avg("cr_score", "cvsc100"),
        total("n_nearprime", "cvsc100 >= 640 AND cvsc100 < 720"), total("n_subprime", "cvsc100 < 640"),
    ]
    return (
        f"SELECT {keys}, {', '.join(parts)} FROM {source} AS ins WHERE ml_exist = 1 AND ml_bal_ins > 0 GROUP BY {keys}"
    )


def active_sql(source: str, keys: str = KEYS) -> str:
    """Plain form: all active consumers aggregated on their own."""
    def total(name: str, test: str) -> str:
        return f"CAST(SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT) AS {name}"

    parts = [
        "COUNT(DISTINCT tu_consumer_id) AS n_active", AVG.format("cvsc100") + " AS cr_score_fsa",
        total("n_nearprime_fsa", "cvsc100 >= 640 AND cvsc100 < 720"), total("n_subprime_fsa", "cvsc100 < 640"),
    ]
    parts += [
        f"CAST(SUM({' + '.join(columns)}) AS DOUBLE) / 1000000 AS {name}"
        for name, columns in region.TOTALS.items()
    ]
    parts += [
        AVG.format("bc_bal") + " AS bc_bal_fsa", f"round(AVG({USE}), 6) AS bc_use_fsa",
        total("n_bc_use_60_80_fsa", f"{USE_NULL} >= CAST(0.6 AS DOUBLE) AND {USE_NULL} < CAST(0.8 AS DOUBLE)"),
        total("n_bc_use_80_plus_fsa", f"{USE_NULL} >= CAST(0.8 AS DOUBLE)"),
    ]
    return f"SELECT {keys}, {', '.join(parts)} FROM {source} AS act GROUP BY {keys}"


def region_ctes(source: str) -> str:
    """insured ⟕ active on the four keys, as panel."""
    return (
        f"insured AS ({insured_sql(source)}), active AS ({active_sql(source)}), "
        "panel AS (SELECT * FROM insured LEFT JOIN active USING (run_date, treated, fm_damage, fsa))"
    )


@query("region_panel", f"WITH {region_ctes('{individual_month}')} SELECT * FROM panel")
def region_panel(inp):
    panel = region.region_panel(inp("individual_month"), "tu_consumer_id")
    return rounded(panel, "bc_use", "bc_use_fsa")


@query("region_totals", active_sql("{individual_month}"))
def region_totals(inp):
    m = region.PanelMeasures("tu_consumer_id")
    region.add_active_measures(m)
    out = m.apply(inp("individual_month"), ["run_date", "treated", "fm_damage", "fsa"])
    return rounded(out, "bc_use_fsa")


@query(
    "region_eligibility",
    f"""
    WITH {region_ctes('{individual_month}')},
    keep AS (SELECT treated, fm_damage, fsa FROM panel WHERE substr(fsa, 2, 1) <> '0'
      GROUP BY 1, 2, 3 HAVING min(n_active) >= 5 OR min(treated) = 1)
    SELECT p.run_date, p.treated, p.fm_damage, p.fsa, p.n_active FROM panel AS p
    JOIN keep ON keep.treated = p.treated AND keep.fm_damage = p.fm_damage AND keep.fsa = p.fsa
    """,
)
def region_eligibility(inp):
    group = ["treated", "fm_damage", "fsa"]
    panel = region.region_panel(inp("individual_month"), "tu_consumer_id").select(
        "run_date", *group, "n_active"
    )
    kept = region.keep_eligible(clean.urban_only(panel, "fsa"), group, "n_active", 5)
    return kept.select("run_date", *group, "n_active")


@query(
    "region_panel_origin",
    f"""
    WITH origin AS (SELECT i.*, h.fsa AS fsa_first FROM {{individual_month}} AS i JOIN
      (SELECT tu_consumer_id, fsa FROM (SELECT tu_consumer_id, fsa,
         row_number() OVER (PARTITION BY tu_consumer_id ORDER BY run_date) AS k FROM {{individual_month}} AS j WHERE ml_bal % 2 = 0) AS q
       WHERE k = 1) AS h ON h.tu_consumer_id = i.tu_consumer_id)
    SELECT run_date, fsa_first, COUNT(DISTINCT tu_consumer_id) AS n_active, CAST(SUM(ml_bal) AS DOUBLE) / 1000000 AS ml_bal_tot,
      CAST(SUM(heloc_bal) AS DOUBLE) / 1000000 AS heloc_bal_tot,
      COUNT(DISTINCT CASE WHEN ml_bal_ins > 0 THEN tu_consumer_id END) AS n_ml_ins,
      CAST(SUM(CASE WHEN ml_bal_ins > 0 THEN ml_bal_ins END) AS DOUBLE) / nullif(COUNT(CASE WHEN ml_bal_ins > 0 THEN 1 END), 0) AS ml_bal_ins
    FROM origin GROUP BY run_date, fsa_first
    """,
)
def region_panel_origin(inp):
    from creditloom.operators import ratings

    rows = inp("individual_month").withColumn("place", F.when(c("ml_bal") % 2 == 0, c("fsa")))
    first = ratings.first_location(rows, "tu_consumer_id", "run_date", ["place"], ["place"], "_first")
    origin = rows.join(first.withColumnRenamed("place_first", "fsa_first"), "tu_consumer_id")
    insured = c("ml_bal_ins") > 0
    m = region.PanelMeasures("tu_consumer_id")
    m.distinct("n_active")
    region.add_totals(m, {k: region.TOTALS[k] for k in ("ml_bal_tot", "heloc_bal_tot")})
    m.distinct("n_ml_ins", insured)
    m.mean("ml_bal_ins", c("ml_bal_ins"), insured)
    return m.apply(origin, ["run_date", "fsa_first"])


@query(
    "descriptive_stats",
    f"""
    WITH {region_ctes('{individual_month}')}, facts AS (
      SELECT treated, fm_damage, fsa, CAST(n_active AS DOUBLE) AS n_active, ml_bal_ins, ml_bal_ins_tot / nullif(ml_bal_tot, 0) AS ml_ins_rt,
        bc_use, CAST(n_nearprime AS DOUBLE) / nullif(n_ml_ins, 0) AS nearprime_rt, CAST(n_subprime AS DOUBLE) / nullif(n_ml_ins, 0) AS subprime_rt
      FROM panel)
    SELECT treated, fm_damage, COUNT(DISTINCT fsa) AS n_fsa,
      {', '.join(f'round(avg({m}), 4) AS {m}_avg, round(stddev_samp({m}), 4) AS {m}_sd' for m in region.FACT_MEASURES)}
    FROM facts GROUP BY treated, fm_damage
    """,
)
def descriptive_stats(inp):
    panel = rounded(region.region_panel(inp("individual_month"), "tu_consumer_id"), "bc_use")
    facts = region.fact_table(panel)
    return rounded(facts, *[f"{m}_{s}" for m in region.FACT_MEASURES for s in ("avg", "sd")], digits=4)


@query(
    "treated_aggregates",
    """
    WITH sums AS (SELECT CAST(unit_id % 2 AS INT) AS fm_damage, run_date,
      CAST(SUM(CAST(bal_tot * 1000000 AS DECIMAL(18,2))) AS DOUBLE) AS bal, CAST(SUM(CAST(n_active AS BIGINT)) AS BIGINT) AS n_active
      FROM {fsa_quarter} AS f WHERE unit_id < 6 GROUP BY 1, 2)
    SELECT fm_damage, run_date, bal, n_active, 100 * CAST(n_active AS DOUBLE) / nullif(bal, 0) AS active_rt FROM sums
    """,
)
def treated_aggregates(inp):
    rows = inp("fsa_quarter").where(c("unit_id") < 6).select(
        (c("unit_id") % 2).alias("fm_damage"),
        "run_date",
        (c("bal_tot") * 1000000).cast("decimal(18,2)").alias("bal"),
        "n_active",
    )
    sums = as_double(region.sum_by(rows, ["fm_damage", "run_date"], ["bal", "n_active"]), "bal")
    return sums.withColumn("active_rt", credit.rate_pct(c("n_active"), c("bal")))


@query(
    "freq_table",
    """
    SELECT TRY_CAST(mop AS INT) AS mop_new, CASE WHEN loc IS NOT DISTINCT FROM CASE WHEN mop = '1' THEN NULL WHEN closed_indic = 'Y' THEN 'signup' ELSE loc END
      THEN 0 ELSE 1 END AS loc_chg, COUNT(*) AS n FROM {trade_day} AS t GROUP BY 1, 2
    """,
)
def freq_table(inp):
    raw = F.when(c("mop") == "1", None).when(c("closed_indic") == "Y", "signup").otherwise(c("loc"))
    rows = quality.location_change(inp("trade_day").withColumn("loc_raw", raw), "loc", "loc_raw")
    return reshape.freq_table(rows.withColumn("mop_new", quality.rating_number("mop")), "mop_new", "loc_chg")


@query(
    "arrears_pivot",
    f"""
    WITH {status_ctes()}, wide AS (
      SELECT run_date, SUM(CASE WHEN CAST(mop AS INT) < 4 THEN {CENTS} END) AS b0, SUM(CASE WHEN CAST(mop AS INT) >= 4 THEN {CENTS} END) AS b4,
        nullif(COUNT(CASE WHEN CAST(mop AS INT) < 4 THEN 1 END), 0) AS n_0, nullif(COUNT(CASE WHEN CAST(mop AS INT) >= 4 THEN 1 END), 0) AS n_4
      FROM status WHERE terminal <> 'WO' GROUP BY run_date)
    SELECT run_date, CAST(b0 AS DOUBLE) AS balance_0, CAST(b4 AS DOUBLE) AS balance_4, n_0, n_4,
      100 * CAST(b4 AS DOUBLE) / nullif(CAST(b0 + b4 AS DOUBLE), 0) AS d90_rt FROM wide
    """,
)
def arrears_pivot(inp):
    out = quality.arrears_pivot(
        day_status(trade_days(inp)), "run_date", "mop", "terminal", "current_balance", "trade_id"
    )
    return as_double(out, "balance_0", "balance_4")


@query(
    "region_checks",
    f"""
    WITH {region_ctes('{individual_month}')}
    SELECT run_date, treated, fm_damage, fsa, ml_bal_ins_tot / nullif(ml_bal_tot, 0) AS ml_ins_rt,
      CAST(n_nearprime + n_subprime AS DOUBLE) / nullif(n_ml_ins, 0) AS belowprime_rt,
      CAST(n_nearprime_fsa + n_subprime_fsa AS DOUBLE) / nullif(n_active, 0) AS belowprime_fsa_rt,
      CAST(n_bc_use_80_plus AS DOUBLE) / nullif(n_ml_ins, 0) AS illiquid_rt,
      CAST(n_bc_use_80_plus_fsa AS DOUBLE) / nullif(n_active, 0) AS illiquid_fsa_rt,
      100 * bc_bal_arr_tot / nullif(bc_bal_tot, 0) AS bc_arr_rt,
      min(n_active) OVER (PARTITION BY fsa, treated, fm_damage) AS min_n_active
    FROM panel
    """,
)
def region_checks(inp):
    checked = scm_study.check_rates(region.region_panel(inp("individual_month"), "tu_consumer_id"))
    return checked.select(
        "run_date", "treated", "fm_damage", "fsa", "ml_ins_rt", "belowprime_rt", "belowprime_fsa_rt",
        "illiquid_rt", "illiquid_fsa_rt", "bc_arr_rt", "min_n_active",
    )


_TREATED_TOTALS = (
    "ml_bal_ins_tot", "ml_bal_arr_ins_tot", "ml_chargoff_new_ins_tot", "ml_bal_tot", "ml_bal_arr_tot", "ml_chargoff_new_tot",
)


@query(
    "treated_index",
    f"""
    WITH {region_ctes('{individual_month}')},
    sums AS (SELECT treated, fm_damage, run_date, {', '.join(f'SUM({m}) AS {m}' for m in _TREATED_TOTALS)} FROM panel
      WHERE treated = 1 AND run_date BETWEEN DATE '1996-01-01' AND DATE '2001-01-01' GROUP BY 1, 2, 3),
    base AS (SELECT treated, fm_damage, ml_bal_ins_tot AS b1, ml_bal_arr_ins_tot AS b2 FROM sums WHERE run_date = DATE '1998-06-01')
    SELECT s.treated, s.fm_damage, s.run_date, {', '.join(f'round(s.{m}, 6) AS {m}' for m in _TREATED_TOTALS)},
      round(100 * ml_bal_arr_ins_tot / nullif(ml_bal_ins_tot, 0), 6) AS ml_ins_arr_rt,
      round(100 * ml_bal_arr_tot / nullif(ml_bal_tot, 0), 6) AS ml_arr_rt,
      round(ml_bal_ins_tot / nullif(b1, 0), 6) AS ml_bal_ins_tot_norm, round(ml_bal_arr_ins_tot / nullif(b2, 0), 6) AS ml_bal_arr_ins_tot_norm
    FROM sums AS s LEFT JOIN base ON base.treated = s.treated AND base.fm_damage = s.fm_damage
    """,
)
def treated_index(inp):
    study = replace(STUDY, window=(D(1996, 1, 1), D(2001, 1, 1)), base_date=D(1998, 6, 1))
    panel = region.region_panel(inp("individual_month"), "tu_consumer_id")
    out = scm_study.treated_aggregates(panel, study)
    return rounded(
        out, *_TREATED_TOTALS, "ml_ins_arr_rt", "ml_arr_rt", "ml_bal_ins_tot_norm", "ml_bal_arr_ins_tot_norm"
    )
