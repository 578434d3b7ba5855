"""The synthetic control study on a region panel: rates, variants, fits and their summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from creditloom.functions import credit
from creditloom.operators import region, reshape, synthetic
from creditloom.operators.synthetic import VARIANT, ScmSpec
from creditloom.plans.study import STUDY, Study

# Quarter labels between the window start and the treatment.
QUARTERS = (
    "yr14_q1", "yr14_q2", "yr14_q3", "yr14_q4",
    "yr15_q1", "yr15_q2", "yr15_q3", "yr15_q4", "yr16_q1",
)
SHARED_SERIES = ("bc_use_60_80", "bc_use_80_plus", "nearprime_rt", "subprime_rt")


def spec_for(outcome: str, level: str, study: Study = STUDY) -> ScmSpec:
    return ScmSpec(
        outcome, level, (*SHARED_SERIES, outcome), QUARTERS, study.window, study.event
    )


ARREARS = spec_for("ml_ins_arr_rt", "ln_ml_bal_ins")
CARD_BALANCE = spec_for("bc_bal", "ln_bc_bal")
CREDIT_SCORE = spec_for("cr_score", "ln_ml_bal_ins")


def derive_rates(panel: DataFrame, over_active: bool = False) -> DataFrame:
    """Percent rates and log levels; ``over_active`` relates the counts to all active consumers."""
    c = F.col
    suffix, base = ("_fsa", "n_active") if over_active else ("", "n_ml_ins")
    return panel.withColumns(
        {
            "ml_ins_arr_rt": credit.rate_pct(c("ml_bal_arr_ins_tot"), c("ml_bal_ins_tot")),
            "bc_use_60_80": credit.rate_pct(c(f"n_bc_use_60_80{suffix}"), c(base)),
            "bc_use_80_plus": credit.rate_pct(c(f"n_bc_use_80_plus{suffix}"), c(base)),
            "nearprime_rt": credit.rate_pct(c(f"n_nearprime{suffix}"), c(base)),
            "subprime_rt": credit.rate_pct(c(f"n_subprime{suffix}"), c(base)),
            "ln_ml_bal_ins": credit.safe_log(c("ml_bal_ins")),
            "ln_bc_bal": credit.safe_log(c("bc_bal")),
            "ln_cr_score": credit.safe_log(c("cr_score")),
        }
    )


def check_rates(panel: DataFrame) -> DataFrame:
    """Quality-control shares, and the smallest active count each region ever had."""
    c = F.col
    below = c("n_nearprime") + c("n_subprime")
    below_all = c("n_nearprime_fsa") + c("n_subprime_fsa")
    shares = panel.withColumns(
        {
            "ml_ins_rt": credit.ratio(c("ml_bal_ins_tot"), c("ml_bal_tot")),
            "belowprime_rt": credit.ratio(below, c("n_ml_ins")),
            "belowprime_fsa_rt": credit.ratio(below_all, c("n_active")),
            "illiquid_rt": credit.ratio(c("n_bc_use_80_plus"), c("n_ml_ins")),
            "illiquid_fsa_rt": credit.ratio(c("n_bc_use_80_plus_fsa"), c("n_active")),
            "bc_arr_rt": credit.rate_pct(c("bc_bal_arr_tot"), c("bc_bal_tot")),
        }
    )
    # A window group is one region's periods.
    per_region = Window.partitionBy("fsa", "treated", "fm_damage")
    return shares.withColumn("min_n_active", F.min("n_active").over(per_region))


def variants(panel: DataFrame) -> DataFrame:
    """Unit ids, and one copy of the controls per damage variant of the treated area.

    The panel is read twice, so pass a materialised one.
    """
    with_ids = panel.join(reshape.unit_ids(panel, "fsa"), "fsa")
    severe, other = F.lit("severe"), F.lit("nonsevere")
    own = F.when(F.col("fm_damage") == 1, F.array(severe)).otherwise(F.array(other))
    member = F.when(F.col("treated") == 0, F.array(severe, other)).otherwise(own)
    return with_ids.withColumn(VARIANT, F.explode(member))


def treated_aggregates(panel: DataFrame, study: Study = STUDY) -> DataFrame:
    """Summed mortgage totals of the treated areas with arrears rates, indexed to the event month."""
    measures = [
        "ml_bal_ins_tot", "ml_bal_arr_ins_tot", "ml_chargoff_new_ins_tot",
        "ml_bal_tot", "ml_bal_arr_tot", "ml_chargoff_new_tot",
    ]
    group = ["treated", "fm_damage"]
    rows = panel.where((F.col("treated") == 1) & F.col("run_date").between(*study.window))
    sums = region.sum_by(rows, [*group, "run_date"], measures).withColumns(
        {
            "ml_ins_arr_rt": credit.rate_pct(F.col("ml_bal_arr_ins_tot"), F.col("ml_bal_ins_tot")),
            "ml_arr_rt": credit.rate_pct(F.col("ml_bal_arr_tot"), F.col("ml_bal_tot")),
        }
    )
    return reshape.index_to_base(
        sums, group, "run_date", study.base_date, ["ml_bal_ins_tot", "ml_bal_arr_ins_tot"]
    )


def placebo_study(
    rows: DataFrame,
    spec: ScmSpec,
    treated: int,
    families: tuple[str, ...] = ("uniform",),
    precision: int = 30,
    nested: bool = False,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
    tasks: int | None = None,
) -> dict[str, DataFrame]:
    """All fits, weights, gaps, p-values and confidence bands of one outcome.

    ``rows`` carries variant, unit_id, run_date and the spec's columns.  Matrices, fits and gaps
    are small but read by several results, so they are materialised once.
    """
    x = materialise(synthetic.predictors(rows, spec))
    y = materialise(synthetic.outcomes(rows, spec))
    units = synthetic.complete_units(x, y)
    packed = synthetic.pack_units(x, y, units)
    fitted = materialise(
        synthetic.fit(synthetic.placebo_jobs(units), packed, nested=nested, tasks=tasks)
    )
    weights = synthetic.drop_failed(
        synthetic.donor_weights(fitted), synthetic.failed_units(fitted)
    )
    gaps = materialise(synthetic.paths(y, weights))
    out = {
        "incomplete": synthetic.incomplete_units(x, y),
        "fits": fitted,
        "weights": weights,
        "predictor_weights": synthetic.predictor_weights(fitted),
        "top_weights": reshape.top_k_per_group(
            weights.where(F.col("job") == str(treated)), [VARIANT], "weight", "donor"
        ),
        "balance": synthetic.balance_table(x, weights, treated),
        "gaps": gaps,
        "pvalue": synthetic.placebo_pvalue(synthetic.rmspe_ratio(gaps), treated),
    }
    for family in families:
        coefs = synthetic.conf_coefs(gaps, weights, treated, family)
        bounds = synthetic.conf_set(coefs, treated, family, precision)
        out[f"conf_{family}"] = synthetic.conf_band(gaps, bounds, treated, family)
    return out


def leave_one_out(
    rows: DataFrame, spec: ScmSpec, treated: int, weights: DataFrame, nested: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Paths and gaps of the treated unit with each of its donors left out in turn."""
    x, y = synthetic.predictors(rows, spec), synthetic.outcomes(rows, spec)
    units = synthetic.complete_units(x, y)
    packed = synthetic.pack_units(x, y, units)
    jobs = synthetic.leave_one_out_jobs(units, weights, treated)
    fitted = synthetic.fit(jobs, packed, nested=nested, tasks=tasks)
    return synthetic.paths(y, synthetic.donor_weights(fitted))
