"""Consumer panels merged over products and aggregated to region panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creditloom.functions import credit
from creditloom.operators import balances, clean, joins, region
from creditloom.plans.study import STUDY, Study

FLOW = ["bal", "bal_arr", "bal_def", "chargoff_new"]


def _names(prefix: str, suffix: str = "") -> list[str]:
    return [f"{prefix}_{m}{suffix}" for m in FLOW]


ML_COLUMNS = _names("ml") + _names("ml", "_ins")
PRODUCT_COLUMNS = {
    "ml": ML_COLUMNS,
    "heloc": _names("heloc"),
    "bc": [*_names("bc"), "bc_lmt"],
    "other": _names("other"),
}
ACTIVE_PARTS = ["ml_bal", "heloc_bal", "other_bal", "bc_lmt"]


def individual_panel(
    panel: DataFrame, loans: dict[str, DataFrame], study: Study = STUDY
) -> DataFrame:
    """Consumer panel with all product blocks, restricted to treated and control areas."""
    keys = ["tu_consumer_id", "run_date"]
    products = {}
    for name, columns in PRODUCT_COLUMNS.items():
        frame = loans[name].withColumnRenamed("ref_date", "run_date")
        # Mortgages and lines come per loan location; cards and other loans are already unique.
        if name in ("ml", "heloc"):
            frame = balances.rollup_consumer(frame, keys, columns)
        products[name] = frame.select(*keys, *columns)
    merged = joins.merge_products(panel, products, keys)
    grouped = region.assign_groups(
        merged, "fsa", study.treated_regions, "prov", study.provinces, "distance_min",
        study.control_km,
    )
    return region.keep_study_units(grouped)


def region_panel(individuals: DataFrame, study: Study = STUDY) -> DataFrame:
    """Region × month panel of eligible regions, by place of residence."""
    active = clean.credit_active(individuals, ACTIVE_PARTS)
    labelled = region.group_label(active, "fsa", study.treated_label)
    panel = region.region_panel(labelled, "tu_consumer_id")
    return _eligible(panel, study)


def _eligible(panel: DataFrame, study: Study) -> DataFrame:
    # The region is part of the group, so dropping rural rows first drops whole groups.
    return region.keep_eligible(
        clean.urban_only(panel, "fsa"), ["treated", "fm_damage", "fsa"], "n_active", study.min_active
    )


def descriptive_table(panel: DataFrame, study: Study = STUDY) -> DataFrame:
    return region.fact_table(panel.where(F.col("run_date").between(*study.window)))


def residential_by_origin(ml: DataFrame, heloc: DataFrame) -> DataFrame:
    """Mortgages and lines of one consumer, month and loan location side by side."""
    place = ["fsa", "encrypted_ldu", "fm_damage", "prov", "distance_min"]

    def at_origin(frame: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
        return frame.select(
            "tu_consumer_id",
            F.col("ref_date").alias("run_date"),
            *[F.col(f"{c}_{prefix}").alias(c) for c in place],
            *columns,
        )

    return joins.full_merge(
        at_origin(ml, "ml", ML_COLUMNS),
        at_origin(heloc, "heloc", PRODUCT_COLUMNS["heloc"]),
        ["tu_consumer_id", "run_date", "fsa", "encrypted_ldu"],
        ["fm_damage", "prov", "distance_min"],
    )


def region_panel_by_origin(
    panel: DataFrame, loans: dict[str, DataFrame], study: Study = STUDY
) -> DataFrame:
    """Region × month panel by the location where the loan was taken out."""
    c = F.col
    keys = ["tu_consumer_id", "run_date"]
    group = ["run_date", "treated", "fm_damage", "fsa"]

    def in_study(frame: DataFrame) -> DataFrame:
        frame = region.assign_groups(
            frame.where(c("run_date").between(*study.origin_window)),
            "fsa", study.treated_regions, "prov", study.provinces, "distance_min",
            study.control_km,
        )
        return region.group_label(region.keep_study_units(frame), "fsa", study.treated_label)

    cards = loans["bc"].withColumnRenamed("ref_date", "run_date")
    others = loans["other"].withColumnRenamed("ref_date", "run_date")
    residents = in_study(panel)
    loans_at_origin = in_study(residential_by_origin(loans["ml"], loans["heloc"]))

    detail = joins.left_attach(
        joins.left_attach(loans_at_origin, residents.select(*keys, "cvsc100"), keys),
        cards.select(*keys, "bc_bal", "bc_lmt"),
        keys,
    ).withColumns(
        {
            "bc_use": credit.utilisation(c("bc_bal"), c("bc_lmt")),
            "bc_bal": F.coalesce("bc_bal", F.lit(0)),
        }
    )
    insured = c("ml_bal_ins") > 0
    m = region.PanelMeasures("tu_consumer_id")
    region.add_totals(
        m, {k: v for k, v in region.TOTALS.items() if k.startswith(("ml_", "heloc_"))}
    )
    m.distinct("n_ml_ins", insured)
    for name in ("ml_bal_ins", "bc_bal", "bc_use"):
        m.mean(name, c(name), insured)
    region.add_use_counts(m, c("bc_use"), "", insured)
    region.add_score_counts(m, c("cvsc100"), "", insured)
    m.total("__rows_ins", F.lit(1), insured)
    none = F.col("__rows_ins").isNull()
    by_origin = m.apply(detail, group)
    # A group without insured holders has no insured measures at all, not zero holders.
    by_origin = by_origin.withColumn("n_ml_ins", F.when(~none, c("n_ml_ins"))).drop("__rows_ins")

    residential = loans_at_origin.groupBy(*keys).agg(
        F.sum("ml_bal").alias("ml_bal"), F.sum("heloc_bal").alias("heloc_bal")
    )
    individuals = residents
    for facts in (
        residential,
        cards.select(*keys, "bc_lmt"),
        others.select(*keys, "other_bal"),
    ):
        individuals = joins.left_attach(individuals, facts, keys)
    individuals = individuals.fillna(0, subset=ACTIVE_PARTS)
    active = region.PanelMeasures("tu_consumer_id")
    active.distinct("n_active")
    counts = active.apply(clean.credit_active(individuals, ACTIVE_PARTS), group)
    return _eligible(by_origin.join(counts, group), study)
