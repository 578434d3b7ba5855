"""Null handling, column swaps and row filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.functions import credit
from creditloom.functions.dates import MONTH, Step


def sentinel_to_null(df: DataFrame, sentinels: Mapping[str, Sequence[int]]) -> DataFrame:
    """Turn missing-value codes into NULL, column by column."""
    return df.withColumns(
        {
            name: F.when(~F.col(name).isin(*codes), F.col(name))
            for name, codes in sentinels.items()
        }
    )


def replace_col(df: DataFrame, name: str, adjusted: str, raw_name: str) -> DataFrame:
    """Keep the reported column under ``raw_name`` and give its name to the adjusted one."""
    return df.withColumnsRenamed({name: raw_name, adjusted: name})


def product_filter(kind: str) -> Column:
    """Row filter for one product family; pushes down to the scan."""
    product, account = F.col("product_type"), F.col("acct_type")
    if kind == "OTHER":
        return (account != "M") & ~product.isin("BC", "ML", "UT")
    return product == kind


def clean_trades(
    df: DataFrame,
    run: str,
    updated: str,
    rating: str,
    balance: str,
    limit: str,
    stale: int = 3,
    step: Step = MONTH,
) -> DataFrame:
    """Drop rows without a balance or limit, and stale rows unless they are in default."""
    fresh = F.col(updated) >= step.shift(F.col(run), -stale)
    return df.where(
        F.col(balance).isNotNull()
        & (F.col(limit) != 0)
        & (fresh | credit.in_default(F.col(rating)))
    )


def credit_active(df: DataFrame, balances: Iterable[str]) -> DataFrame:
    """Consumers with any balance or card limit; a NULL component excludes the row, as in a SQL sum."""
    total = None
    for name in balances:
        total = F.col(name) if total is None else total + F.col(name)
    return df.where(total > 0)


def urban_only(df: DataFrame, region: str) -> DataFrame:
    """A zero in second place marks a rural postal region."""
    return df.where(F.substring(F.col(region), 2, 1) != "0")
