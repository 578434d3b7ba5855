"""End-to-end plans from bureau-shaped files to region panels."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from creditloom.operators import region
from creditloom.plans import consumers, regions, trades
from creditloom.plans.study import STUDY
from creditloom.session import colocate, cut_lineage
from workload import bureau_sql as sql
from workload.queries.aggregates import active_sql, insured_sql, region_ctes
from workload.registry import query, rounded

c = F.col

# The fixture covers 2015-01 … 2017-06 with few consumers per region.
FIXTURE = replace(
    STUDY,
    history_start=dt.date(2015, 1, 1),
    monthly_since=2016,
    owner_since=2015,
    accounts_start=dt.date(2015, 2, 1),
    min_active=sql.MIN_ACTIVE,
)


def consumer_panel(inp):
    return consumers.consumer_panel(
        inp("bureau_consumer"), inp("bureau_geo"), inp("bureau_damaged"), inp("bureau_mapping"), FIXTURE,
        materialise=cut_lineage,
    )


def cleaned(inp, panel, product):
    return trades.clean_accounts(
        inp("bureau_account"), panel, product, FIXTURE, materialise=cut_lineage
    )


def adjusted(inp, panel, product, materialise=cut_lineage):
    return trades.time_adjust(cleaned(inp, panel, product), panel, product, FIXTURE, materialise)


def loans(inp, panel, product):
    return trades.consumer_loans(adjusted(inp, panel, product), product)


def all_loans(inp, panel):
    """Loans of all families, next to each other by consumer and month, as they are merged on both."""
    return trades.all_consumer_loans(
        inp("bureau_account"), panel, FIXTURE, cut_lineage, lambda df: colocate(df, ["tu_consumer_id", "ref_date"])
    )


@query(
    "pipe_consumer_panel",
    f"WITH {sql.consumer()} SELECT * REPLACE (round(distance_min, 4) AS distance_min) FROM crc",
)
def pipe_consumer_panel(inp):
    return rounded(consumer_panel(inp), "distance_min", digits=4)


@query("pipe_tenure", f"WITH {sql.consumer()}, {sql.tenure()} SELECT * FROM tenure")
def pipe_tenure(inp):
    return consumers.tenure_panel(
        inp("bureau_consumer"), consumer_panel(inp), inp("bureau_account"), FIXTURE, with_check=True,
        materialise=cut_lineage,
    )


COMBINED = """
SELECT crc.tu_consumer_id, crc.run_date, crc.fsa, crc.encrypted_ldu, t.homeowner_mrtg, t.stay_dur, t.stay_censored,
  h.heloc_bal, h.heloc_lmt, h.n_heloc, m.ml_bal, m.n_ml,
  CASE WHEN coalesce(h.n_heloc, 0) > 0 OR coalesce(t.homeowner_mrtg, 0) = 1 THEN 1 ELSE 0 END AS homeowner
FROM crc LEFT JOIN tenure AS t ON t.tu_consumer_id = crc.tu_consumer_id AND t.run_date = crc.run_date
LEFT JOIN heloc_ind AS h ON h.tu_consumer_id = crc.tu_consumer_id AND year(h.ref_date) = year(crc.run_date) AND month(h.ref_date) = month(crc.run_date)
LEFT JOIN ml_ind AS m ON m.tu_consumer_id = crc.tu_consumer_id AND year(m.ref_date) = year(crc.run_date) AND month(m.ref_date) = month(crc.run_date)
"""


@query(
    "pipe_consumer_combined",
    f"WITH {sql.products('ML', 'HELOC')}, {sql.tenure()} {COMBINED}",
)
def pipe_consumer_combined(inp):
    panel = cut_lineage(consumer_panel(inp))
    tenure = consumers.tenure_panel(
        inp("bureau_consumer"), panel, inp("bureau_account"), FIXTURE, materialise=cut_lineage
    )
    out = consumers.combined_consumers(
        panel, tenure, loans(inp, panel, "HELOC"), loans(inp, panel, "ML")
    )
    return out.select(
        "tu_consumer_id", "run_date", "fsa", "encrypted_ldu", "homeowner_mrtg", "stay_dur",
        "stay_censored", "heloc_bal", "heloc_lmt", "n_heloc", "ml_bal", "n_ml", "homeowner",
    )


for _product in trades.PREFIX:
    _name = _product.lower()

    @query(
        "pipe_trade_clean" if _product == "ML" else f"pipe_trade_clean_{_name}",
        f"WITH {sql.consumer()}, {sql.FACTORS}, {sql.accounts(_product)} SELECT * FROM {_name}_clean",
    )
    def pipe_trade_clean(inp, product=_product):
        return cleaned(inp, cut_lineage(consumer_panel(inp)), product)

    @query(
        "pipe_time_adjust" if _product == "ML" else f"pipe_time_adjust_{_name}",
        f"WITH {sql.consumer()}, {sql.FACTORS}, {sql.accounts(_product)}, {sql.adjusted(_product)} "
        + f"SELECT * {f'REPLACE (round(distance_min_{_name}, 4) AS distance_min_{_name})' if _product in trades.LOCATED else ''} FROM {_name}_adj",
    )
    def pipe_time_adjust(inp, product=_product, name=_name):
        out = adjusted(inp, cut_lineage(consumer_panel(inp)), product)
        return rounded(out, f"distance_min_{name}", digits=4) if product in trades.LOCATED else out

    @query(
        "pipe_consumer_loans" if _product == "ML" else f"pipe_consumer_loans_{_name}",
        f"WITH {sql.products(_product)} "
        + f"SELECT * {f'REPLACE (round(distance_min_{_name}, 4) AS distance_min_{_name})' if _product in trades.LOCATED else ''} FROM {_name}_ind",
    )
    def pipe_consumer_loans(inp, product=_product, name=_name):
        out = loans(inp, cut_lineage(consumer_panel(inp)), product)
        return rounded(out, f"distance_min_{name}", digits=4) if product in trades.LOCATED else out


ALL = sql.products("ML", "HELOC", "BC", "OTHER")
ACTIVE = """df_active AS (SELECT * REPLACE (CASE WHEN treated = 1 THEN 'T9(H|J|K)' ELSE fsa END AS fsa) FROM df_ind
  WHERE ml_bal + heloc_bal + other_bal + bc_lmt > 0)"""
KEEP = f"""keep AS (SELECT treated, fm_damage, fsa FROM panel WHERE substr(fsa, 2, 1) <> '0'
  GROUP BY 1, 2, 3 HAVING min(n_active) >= {sql.MIN_ACTIVE} OR min(treated) = 1),
df_synth AS (SELECT panel.* FROM panel JOIN keep USING (treated, fm_damage, fsa))"""
PANEL_CTES = f"{ALL}, {sql.merged()}, {ACTIVE}, {region_ctes('df_active')}, {KEEP}"


def bureau_region_panel(inp):
    panel = colocate(consumer_panel(inp), ["tu_consumer_id", "run_date"])
    individuals = regions.individual_panel(panel, all_loans(inp, panel), FIXTURE)
    return regions.region_panel(individuals, FIXTURE)


@query("pipe_region_panel", f"WITH {PANEL_CTES} SELECT * FROM df_synth")
def pipe_region_panel(inp):
    return rounded(bureau_region_panel(inp), "bc_use", "bc_use_fsa")


@query(
    "pipe_region_facts",
    f"""
    WITH {PANEL_CTES}, facts AS (
      SELECT treated, fm_damage, fsa, CAST(n_active AS DOUBLE) AS n_active, ml_bal_ins, ml_bal_ins_tot / nullif(ml_bal_tot, 0) AS ml_ins_rt,
        bc_use, CAST(n_nearprime AS DOUBLE) / nullif(n_ml_ins, 0) AS nearprime_rt, CAST(n_subprime AS DOUBLE) / nullif(n_ml_ins, 0) AS subprime_rt
      FROM df_synth WHERE run_date BETWEEN DATE '2014-01-01' AND DATE '2018-01-01')
    SELECT treated, fm_damage, COUNT(DISTINCT fsa) AS n_fsa,
      {', '.join(f'round(avg({m}), 4) AS {m}_avg, round(stddev_samp({m}), 4) AS {m}_sd' for m in region.FACT_MEASURES)}
    FROM facts GROUP BY treated, fm_damage
    """,
)
def pipe_region_facts(inp):
    facts = regions.descriptive_table(rounded(bureau_region_panel(inp), "bc_use"), FIXTURE)
    return rounded(facts, *[f"{m}_{s}" for m in region.FACT_MEASURES for s in ("avg", "sd")], digits=4)


_FLOW = ["bal", "bal_arr", "bal_def", "chargoff_new"]
_ML = [f"ml_{m}" for m in _FLOW] + [f"ml_{m}_ins" for m in _FLOW]
_HELOC = [f"heloc_{m}" for m in _FLOW]
_USE = "coalesce(CAST(bc_bal AS DOUBLE) / nullif(bc_lmt, 0), 0)"
_TOTALS = ", ".join(
    f"CAST(SUM({' + '.join(parts)}) AS DOUBLE) / 1000000 AS {name}"
    for name, parts in region.TOTALS.items()
    if name.startswith(("ml_", "heloc_"))
)
_WINDOW = "BETWEEN DATE '2014-02-01' AND DATE '2018-01-01'"
_STUDY = (
    f"({sql.IN_AREA.format('fsa')} OR (regexp_matches(prov, 'AB|SK') AND distance_min >= 100))"
)
_LABEL = f"CASE WHEN {sql.IN_AREA.format('fsa')} THEN 'T9(H|J|K)' ELSE fsa END"
ORIGIN_CTES = f"""
{ALL},
resl_raw AS (
  SELECT coalesce(m.tu_consumer_id, h.tu_consumer_id) AS tu_consumer_id, coalesce(m.ref_date, h.ref_date) AS run_date,
    coalesce(m.fsa_ml, h.fsa_heloc) AS fsa, coalesce(m.prov_ml, h.prov_heloc) AS prov,
    coalesce(m.fm_damage_ml, h.fm_damage_heloc, 0) AS fm_damage, coalesce(m.distance_min_ml, h.distance_min_heloc, 0) AS distance_min,
    {', '.join(f'coalesce({m}, 0) AS {m}' for m in _ML + _HELOC)}
  FROM ml_ind AS m FULL JOIN heloc_ind AS h ON m.tu_consumer_id = h.tu_consumer_id AND m.ref_date = h.ref_date
    AND m.fsa_ml = h.fsa_heloc AND m.encrypted_ldu_ml = h.encrypted_ldu_heloc),
resl AS (SELECT * REPLACE ({_LABEL} AS fsa), CAST({sql.IN_AREA.format('fsa')} AS INT) AS treated FROM resl_raw
  WHERE run_date {_WINDOW} AND {_STUDY}),
home AS (SELECT tu_consumer_id, run_date, {_LABEL} AS fsa, fm_damage, cvsc100, CAST({sql.IN_AREA.format('fsa')} AS INT) AS treated FROM crc
  WHERE run_date {_WINDOW} AND {_STUDY}),
detail AS (
  SELECT r.*, home.cvsc100, coalesce(b.bc_bal, 0) AS bc_bal, b.bc_lmt FROM resl AS r
  LEFT JOIN home ON home.tu_consumer_id = r.tu_consumer_id AND home.run_date = r.run_date
  LEFT JOIN bc_ind AS b ON b.tu_consumer_id = r.tu_consumer_id AND b.ref_date = r.run_date),
totals AS (SELECT run_date, treated, fm_damage, fsa, {_TOTALS} FROM detail GROUP BY 1, 2, 3, 4),
holders AS (
  SELECT run_date, treated, fm_damage, fsa, COUNT(DISTINCT tu_consumer_id) AS n_ml_ins,
    CAST(SUM(ml_bal_ins) AS DOUBLE) / COUNT(*) AS ml_bal_ins, CAST(SUM(bc_bal) AS DOUBLE) / COUNT(*) AS bc_bal,
    round(AVG({_USE}), 6) AS bc_use,
    CAST(SUM(CASE WHEN {_USE} >= CAST(0.6 AS DOUBLE) AND {_USE} < CAST(0.8 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_bc_use_60_80,
    CAST(SUM(CASE WHEN {_USE} >= CAST(0.8 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_bc_use_80_plus,
    CAST(SUM(CASE WHEN cvsc100 >= 640 AND cvsc100 < 720 THEN 1 ELSE 0 END) AS BIGINT) AS n_nearprime,
    CAST(SUM(CASE WHEN cvsc100 < 640 THEN 1 ELSE 0 END) AS BIGINT) AS n_subprime
  FROM detail WHERE ml_bal_ins > 0 GROUP BY 1, 2, 3, 4),
resl_c AS (SELECT tu_consumer_id, run_date, SUM(ml_bal) AS ml_bal, SUM(heloc_bal) AS heloc_bal FROM resl GROUP BY 1, 2),
active_n AS (
  SELECT home.run_date, home.treated, home.fm_damage, home.fsa, COUNT(DISTINCT home.tu_consumer_id) AS n_active FROM home
  LEFT JOIN resl_c AS r ON r.tu_consumer_id = home.tu_consumer_id AND r.run_date = home.run_date
  LEFT JOIN bc_ind AS b ON b.tu_consumer_id = home.tu_consumer_id AND b.ref_date = home.run_date
  LEFT JOIN other_ind AS o ON o.tu_consumer_id = home.tu_consumer_id AND o.ref_date = home.run_date
  WHERE coalesce(r.ml_bal, 0) + coalesce(r.heloc_bal, 0) + coalesce(o.other_bal, 0) + coalesce(b.bc_lmt, 0) > 0 GROUP BY 1, 2, 3, 4),
panel AS (SELECT * FROM totals LEFT JOIN holders USING (run_date, treated, fm_damage, fsa) JOIN active_n USING (run_date, treated, fm_damage, fsa))
"""


@query("pipe_region_panel_origin", f"WITH {ORIGIN_CTES}, {KEEP} SELECT * FROM df_synth")
def pipe_region_panel_origin(inp):
    panel = cut_lineage(consumer_panel(inp))
    out = regions.region_panel_by_origin(panel, all_loans(inp, panel), FIXTURE)
    return rounded(out, "bc_use")
