"""Account rows to consumer rows: balances by state, active counts and limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.functions import credit

MEASURES = ("bal", "bal_arr", "bal_def", "chargoff", "chargoff_new")


def _conditional_sum(test: Column, value: Column) -> Column:
    return F.sum(F.when(test, value).otherwise(0))


def balance_measures(
    prefix: str,
    balance: str,
    rating: str,
    terminal: str,
    charged: str,
    charged_new: str,
    subset: Column | None = None,
    suffix: str = "",
) -> list[Column]:
    """Balance, arrears, default, charge-off stock and charge-off flow as conditional sums."""
    state, grade = F.col(terminal), F.col(rating)
    live, lost = state != "WO", state == "WO"
    if subset is not None:
        live, lost = live & subset, lost & subset
    parts = {
        "bal": (live, balance),
        "bal_arr": (live & credit.in_arrears(grade), balance),
        "bal_def": (live & credit.in_default(grade), balance),
        "chargoff": (lost, charged),
        "chargoff_new": (lost, charged_new),
    }
    return [
        _conditional_sum(test, F.col(value)).alias(f"{prefix}_{name}{suffix}")
        for name, (test, value) in parts.items()
    ]


def active_measures(
    prefix: str, id_col: str, terminal: str, limit: str, nullable_keys: Sequence[str] = ()
) -> list[Column]:
    """Number and limit of accounts neither paid nor written off; NULL when there are none.

    Groups with a NULL among ``nullable_keys`` also get NULL, as an equality join back would give.
    """
    active = ~F.col(terminal).isin("PD", "WO")
    n = F.count(F.when(active, F.col(id_col)))
    total = F.sum(F.when(active, F.col(limit)))
    # A group with active rows but NULL ids counts 0 and must not turn into "none active".
    any_active = F.max(active)
    if nullable_keys:
        any_active = any_active & reduce(
            lambda a, b: a & b, [F.col(k).isNotNull() for k in nullable_keys]
        )
    return [
        F.when(any_active, n).alias(f"n_{prefix}"),
        F.when(any_active, total).alias(f"{prefix}_lmt"),
    ]


def consumer_loans(
    df: DataFrame,
    keys: Sequence[str],
    prefix: str,
    id_col: str,
    balance: str = "current_balance",
    rating: str = "mop",
    terminal: str = "terminal",
    charged: str = "chargoff_refine",
    charged_new: str = "chargoff_new",
    limit: str = "cr_lmt",
    insured: str | None = None,
    nullable_keys: Sequence[str] = (),
) -> DataFrame:
    """All consumer-product measures in one aggregation over the account panel."""
    names = (balance, rating, terminal, charged, charged_new)
    measures = balance_measures(prefix, *names)
    if insured:
        measures += balance_measures(prefix, *names, subset=F.col(insured) == 1, suffix="_ins")
    measures += active_measures(prefix, id_col, terminal, limit, nullable_keys)
    return df.groupBy(*keys).agg(*measures)


def rollup_consumer(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sum measures across loan locations."""
    return df.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def having_ever(df: DataFrame, id_col: str, *tests: Column) -> DataFrame:
    """Distinct ids with any row passing any test."""
    return df.where(reduce(lambda a, b: a | b, tests)).select(id_col).distinct()
