"""Account files to cleaned accounts, time-adjusted accounts and consumer-product panels."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from creditloom.functions import credit, dates
from creditloom.functions.dates import MONTH
from creditloom.operators import asof, balances, clean, joins, ratings, status
from creditloom.plans.study import STUDY, Study

# Product families: prefix of the consumer-level columns.
PREFIX = {"ML": "ml", "HELOC": "heloc", "BC": "bc", "OTHER": "other"}
LOCATED = ("ML", "HELOC")
LOAN_LOCATION = ["fsa", "encrypted_ldu", "prov", "distance_min", "fm_damage"]
HELOC_MIN_LIMIT = 50000

DATE_TEXT = {
    "reported_dt": "reported_date",
    "last_updated_dt": "last_updated_date",
    "opened_dt": "opened_date",
    "closed_dt": "closed_date",
    "file_since_dt": "file_since_date",
}
CARD_ONLY = ["paymt_amt", "activity_period"]


def read_accounts(accounts: DataFrame, product: str) -> DataFrame:
    """Rows of one product family with parsed dates and the latest 12 payment marks."""
    family = "LC" if product == "HELOC" else product
    plain = [
        "tu_consumer_id", "tu_trade_id", "joint_account_id", "primary_indicator", "acct_type",
        "product_type", "best_amt_flag", "credit_limit", "high_credit_amt", "narrative_code1",
        "narrative_code2", "closed_indic", "current_balance", "chargoff_amt", "mop", "l3",
        "terms_dur", "terms_frequency", "terms_amt", "months_reviewed", "run_date",
    ]
    extra = []
    if product == "ML":
        extra = [F.col("insurance_indicator")]
    elif product == "BC":
        extra = [*map(F.col, CARD_ONLY), F.col("tu_acct_num").alias("bin")]
    return accounts.where(clean.product_filter(family)).select(
        *plain,
        F.substring("paymt_pat", 1, 12).alias("paymt_pat"),
        *extra,
        *[dates.ymd_to_date(F.col(text)).alias(name) for text, name in DATE_TEXT.items()],
    )


def derive_amounts(df: DataFrame) -> DataFrame:
    """Refined limit, reported limit, refined charge-off and monthly payment."""
    c = F.col
    amounts = (c("best_amt_flag"), c("credit_limit"), c("high_credit_amt"))
    return df.withColumns(
        {
            "cr_lmt": credit.credit_limit(*amounts, c("current_balance")),
            "cr_lmt_woadj": credit.credit_limit_raw(*amounts),
            "chargoff_refine": credit.chargeoff(
                c("narrative_code1"), c("narrative_code2"), c("chargoff_amt"), c("current_balance")
            ),
            "terms_pay": credit.monthly_payment(c("terms_frequency"), c("terms_amt")),
        }
    ).drop("best_amt_flag", "high_credit_amt", "credit_limit", "chargoff_amt")


def heloc_ids(derived: DataFrame) -> DataFrame:
    """Lines of credit that ever had a large limit or were ever marked as secured."""
    return balances.having_ever(
        derived,
        "tu_trade_id",
        F.col("cr_lmt") >= HELOC_MIN_LIMIT,
        credit.has_narrative("SB", F.col("narrative_code1"), F.col("narrative_code2")),
    )


def sample_accounts(accounts: DataFrame, panel: DataFrame, study: Study = STUDY) -> DataFrame:
    """Account rows of all families for sampled consumers, with one month of context before the start.

    One scan and one semi join for everything that follows; written once, the families prune it.
    """
    first = MONTH.shift(F.lit(study.accounts_start), -1)
    families = [clean.product_filter("LC" if f == "HELOC" else f) for f in PREFIX]
    rows = accounts.where(reduce(or_, families) & (F.col("run_date") >= first))
    return joins.keep_ever(rows, "tu_consumer_id", panel.select("tu_consumer_id").distinct())


def sampled_rows(
    accounts: DataFrame, panel: DataFrame | None, product: str, study: Study = STUDY
) -> DataFrame:
    """Rows of one family for sampled consumers; without a panel, ``accounts`` are sampled already."""
    rows = accounts if panel is None else sample_accounts(accounts, panel, study)
    return read_accounts(rows, product)


def line_ids(accounts: DataFrame, panel: DataFrame | None, study: Study = STUDY) -> DataFrame:
    """Home-equity lines among the sampled consumers' lines of credit."""
    return heloc_ids(derive_amounts(sampled_rows(accounts, panel, "HELOC", study)))


def add_product_category(df: DataFrame, lines: DataFrame) -> DataFrame:
    c = F.col
    flagged = joins.flag_sites(df, lines, ["tu_trade_id"], "__line")
    category = credit.product_category(
        c("product_type"), c("acct_type"), c("cr_lmt"), c("terms_dur"), c("l3"),
        c("narrative_code1"), c("narrative_code2"), c("__line") == 1,
    )
    return flagged.withColumn("product_cat", category).drop("__line")


def clean_accounts(
    accounts: DataFrame,
    panel: DataFrame | None,
    product: str,
    study: Study = STUDY,
    lines: DataFrame | None = None,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Cleaned account-month rows with status, from one month of context before the start on.

    ``lines`` are the home-equity lines, if already known.  ``materialise`` is applied to the rows
    with status: the group sizes and all later steps read them again.
    """
    c = F.col
    rows = sampled_rows(accounts, panel, product, study)
    if product == "ML":
        rows = joins.flag_ever(rows, "tu_trade_id", c("insurance_indicator") == "Y", "ml_insured")
    rows = derive_amounts(rows)
    if product in ("HELOC", "OTHER") and lines is None:
        lines = line_ids(accounts, panel, study)
    if product == "HELOC":
        rows = joins.keep_ever(rows, "tu_trade_id", lines)
    elif product == "OTHER":
        rows = add_product_category(rows, lines).where(c("product_cat") != "HELOC")
        rows = rows.drop("narrative_code1", "narrative_code2")
    rows = clean.clean_trades(
        rows, "run_date", "last_updated_date", "mop", "current_balance", "cr_lmt"
    )
    rows = status.prev_period_status(
        rows, "tu_trade_id", "run_date", "current_balance", "chargoff_refine", "closed_indic",
        "acct_type", "opened_date",
    ).drop("closed_indic", "acct_type", "product_type")
    rows = materialise(rows)
    rows = status.with_group_size(
        rows, ["run_date", "joint_account_id"], "tu_consumer_id", "n_now"
    )
    return rows.where(c("run_date") >= F.lit(study.accounts_start))


def revise_ratings(df: DataFrame, study: Study = STUDY) -> DataFrame:
    """History revision and deferral adjustment of rows that carry treated_ind."""
    facts = ratings.revision_facts(
        df, "tu_trade_id", "ref_date", "paymt_pat", "months_reviewed", study.revision
    )
    revised = ratings.revise_from_history(
        df, facts, "tu_trade_id", "ref_date", "mop", "months_reviewed",
        study.revision_start, study.revision, "mop_rev",
    )
    adjusted = ratings.deferral_adjust(
        revised, "tu_trade_id", "ref_date", "mop_rev", F.col("treated_ind") == 1,
        study.relief_before, study.relief, study.relief_after, "mop_adj",
    )
    return clean.replace_col(adjusted, "mop", "mop_adj", "mop_raw")


def time_adjust(
    cleaned: DataFrame,
    panel: DataFrame,
    product: str,
    study: Study = STUDY,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Accounts as of each reference month, with revised ratings and the loan's first location.

    ``materialise`` is applied once to the rebuilt panel, which several branches read.
    """
    rebuilt = asof.rebuild_as_of(cleaned, "tu_trade_id", "run_date", "reported_date", "terminal")
    located = product in LOCATED
    facts = panel.select(
        "tu_consumer_id", "run_date", "treated_ind", *(LOAN_LOCATION if located else [])
    )
    # One consumer join serves both the cohort flag and the loan locations.
    rebuilt = materialise(joins.left_attach(rebuilt, facts, ["tu_consumer_id", "run_date"]))
    revised = revise_ratings(rebuilt, study)
    if not located:
        return revised
    origin = ratings.first_location(
        rebuilt, "tu_trade_id", "ref_date", LOAN_LOCATION, ["fsa", "encrypted_ldu"],
        f"_{PREFIX[product]}",
    )
    return joins.left_attach(revised.drop(*LOAN_LOCATION), origin, ["tu_trade_id"])


def consumer_loans(adjusted: DataFrame, product: str) -> DataFrame:
    """Consumer × reference month (× loan location) measures of one product family."""
    prefix = PREFIX[product]
    place = [f"{c}_{prefix}" for c in LOAN_LOCATION] if product in LOCATED else []
    return balances.consumer_loans(
        adjusted,
        ["tu_consumer_id", "ref_date", *place],
        prefix,
        "tu_trade_id",
        insured="ml_insured" if product == "ML" else None,
        nullable_keys=place,
    )


def all_consumer_loans(
    accounts: DataFrame,
    panel: DataFrame,
    study: Study = STUDY,
    materialise: Callable[[DataFrame], DataFrame] = lambda df: df,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Consumer-product panels of all families, by column prefix; ``store`` keeps them, if not ``materialise``.

    The families do not depend on each other, so their stages are submitted side by side and
    share the cluster instead of leaving it idle at the end of each stage.
    """

    sampled = materialise(sample_accounts(accounts, panel, study))
    # Both the line family and the other loans need to know which lines are home-equity lines.
    lines = materialise(line_ids(sampled, None, study))

    def one(product: str) -> DataFrame:
        cleaned = clean_accounts(sampled, None, product, study, lines, materialise)
        adjusted = time_adjust(cleaned, panel, product, study, materialise)
        return (store or materialise)(consumer_loans(adjusted, product))

    with ThreadPoolExecutor(len(PREFIX)) as pool:
        return dict(zip(PREFIX.values(), pool.map(one, PREFIX)))
