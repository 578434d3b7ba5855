"""Consumer panel, tenure and combined consumer data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from creditloom.functions import credit, dates, geo
from creditloom.operators import clean, joins, spatial, tenure
from creditloom.plans.study import STUDY, Study

LOCATION = ["fsa", "encrypted_ldu"]


def postal_table(geography: DataFrame, damaged: DataFrame, study: Study = STUDY) -> DataFrame:
    """(fsa, ldu) → damage flag and distance to the treated area; one row per postal code.

    The lookup is deduplicated, so that it cannot multiply consumer rows.
    """
    region, unit = geo.split_postal(F.col("pstlcode"))
    codes = geography.select(
        region.alias("fsa"), unit.alias("ldu"), "province", "latitude", "longitude"
    )
    sites = codes.where(F.col("fsa").rlike(study.treated_regions))
    measured = spatial.min_distance(codes, sites)
    in_scope = F.col("province").rlike("|".join(study.province_names))
    nearest = measured.groupBy("fsa", "ldu").agg(
        F.min(F.when(in_scope, F.col("distance_min"))).alias("distance_min")
    )
    return joins.flag_sites(nearest, damaged, ["fsa", "ldu"], "fm_damage")


def consumer_panel(
    consumers: DataFrame,
    geography: DataFrame,
    damaged: DataFrame,
    mapping: DataFrame,
    study: Study = STUDY,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Cleaned consumer-month rows of everybody ever seen in the study provinces.

    ``materialise`` is applied to the sampled rows, which are read twice, and to the postal lookup,
    whose size decides how it is joined.
    """
    c = F.col
    base = clean.sentinel_to_null(
        consumers.withColumn("run_date", dates.ym_to_date(c("run_date"))),
        {"as115": [0], "cvsc100": [-8, 0]},
    )
    base = base.select(
        "tu_consumer_id",
        "run_date",
        *LOCATION,
        credit.normalise_age(c("go30")).alias("age"),
        credit.province(c("fsa"), c("go90")).alias("prov"),
        "as115",
        "cvsc100",
        credit.band(c("as115"), credit.RISK_SCORE_CUTS).alias("as115_tier"),
        credit.band(c("cvsc100"), credit.CREDIT_SCORE_CUTS).alias("cvsc100_tier"),
        c("go91").alias("deceased"),
    )
    members = base.where(c("prov").rlike("|".join(study.provinces))).select("tu_consumer_id").distinct()
    alive = joins.keep_ever(base.where(c("deceased") == "N"), "tu_consumer_id", members)
    adjusted = joins.address_override(
        materialise(alive.drop("deceased")),
        "tu_consumer_id",
        "run_date",
        LOCATION,
        anchor=c("run_date") == F.lit(study.event),
        inside=c("fsa").rlike(study.treated_regions),
        window=study.evacuation,
        flag="treated_ind",
    )
    keyed = joins.translate_key(adjusted, mapping, "encrypted_ldu", "ldu", "n_repeat")
    codes = joins.checked_broadcast(materialise(postal_table(geography, damaged, study)))
    return joins.enrich(keyed, codes, ["fsa", "ldu"], "inner").drop("ldu")


def mortgage_history(accounts: DataFrame, study: Study = STUDY) -> DataFrame:
    """Opening, closing and on-file months of every mortgage not in late default."""
    c = F.col
    loans = accounts.where((c("product_type") == "ML") & ~c("mop").rlike("[89]")).select(
        "tu_consumer_id",
        "tu_trade_id",
        "run_date",
        "closed_indic",
        "current_balance",
        dates.ym_to_date(c("opened_dt")).alias("opened"),
        dates.ym_to_date(c("closed_dt")).alias("closed"),
        dates.ym_to_date(c("last_paymt_dt")).alias("paid"),
        dates.ymd_to_date(c("file_since_dt")).alias("since"),
        dates.ymd_to_date(c("last_updated_dt")).alias("updated"),
    )
    opened = dates.opened_or_estimated(c("opened"), c("paid"))
    closed = dates.closed_or_last_payment(
        c("closed"), c("paid"), c("closed_indic"), c("current_balance")
    )
    return loans.select(
        "tu_consumer_id",
        "tu_trade_id",
        "run_date",
        F.when(c("current_balance") > 0, 1).otherwise(0).alias("active_mrtg"),
        dates.opened_bucket(opened, study.monthly_since).alias("opened_qtr"),
        dates.closed_bucket(closed, study.monthly_since).alias("closed_qtr"),
        F.coalesce("since", "updated").alias("file_since_date"),
    )


def tenure_panel(
    history: DataFrame,
    sample: DataFrame,
    accounts: DataFrame,
    study: Study = STUDY,
    with_check: bool = False,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Home ownership and length of stay for the sampled consumers' whole history.

    ``materialise`` is applied to that history, which three branches read.
    """
    c = F.col
    where = ["fsa", "ldu"]
    sampled = joins.keep_ever(
        history.select(
            "tu_consumer_id",
            dates.ym_to_date(c("run_date")).alias("run_date"),
            "fsa",
            c("encrypted_ldu").alias("ldu"),
            c("mc33").alias("ml_bal_crc"),
        ),
        "tu_consumer_id",
        sample.select("tu_consumer_id").distinct(),
    )
    rows = materialise(sampled)
    loans = mortgage_history(accounts, study)
    counts = None
    if with_check:
        counts = loans.groupBy("tu_consumer_id", "run_date").agg(
            F.count("tu_trade_id").alias("n_all_mrtg")
        )
    anchors = tenure.loan_anchors(
        loans, "tu_consumer_id", "opened_qtr", "closed_qtr", "file_since_date", "active_mrtg"
    )
    owners = tenure.homeowner_inference(
        rows.where(F.year("run_date") >= study.owner_since),
        rows,
        anchors,
        "tu_consumer_id",
        "run_date",
        where,
        "ml_bal_crc",
        counts,
    )
    weight = F.when(F.year("run_date") >= study.monthly_since, 1).otherwise(3)
    stays = tenure.stay_duration(
        rows, "tu_consumer_id", where, "run_date", weight, study.history_start
    ).where(F.year("run_date") >= study.monthly_since)
    kept = ["tu_consumer_id", "run_date", *where, "homeowner_mrtg"]
    if with_check:
        kept += ["n_all_mrtg", "mrtg_null_refine"]
    # The stay belongs to the consumer-month, whichever address it is counted at.
    return joins.left_attach(owners.select(*kept), stays.drop(*where), ["tu_consumer_id", "run_date"])


def combined_consumers(
    panel: DataFrame, tenure_rows: DataFrame, lines: DataFrame, mortgages: DataFrame
) -> DataFrame:
    """Consumer panel with tenure, home-equity lines and mortgages of the same month."""
    keys = ["tu_consumer_id"]
    out = joins.left_attach(panel, tenure_rows.drop("fsa", "ldu"), [*keys, "run_date"])
    out = joins.join_same_month(
        out,
        "run_date",
        lines.select(*keys, "ref_date", "heloc_bal", "heloc_lmt", "n_heloc"),
        "ref_date",
        keys,
    )
    out = out.withColumn("homeowner", tenure.homeowner(F.col("n_heloc"), F.col("homeowner_mrtg")))
    return joins.join_same_month(
        out, "run_date", mortgages.select(*keys, "ref_date", "ml_bal", "n_ml"), "ref_date", keys
    )
