"""Retrospective rating revisions and the first known location of a loan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from creditloom.functions import credit
from creditloom.operators.joins import left_attach


def revision_facts(df: DataFrame, id_col: str, date: str, pattern: str, reviewed: str, rev_date) -> DataFrame:
    """Payment pattern and months reviewed of each account at the revision date."""
    return df.where(F.col(date) == F.lit(rev_date)).select(
        id_col, F.col(pattern).alias("__rev_pattern"), F.col(reviewed).alias("__rev_reviewed")
    )


def revise_from_history(
    df: DataFrame,
    facts: DataFrame,
    id_col: str,
    date: str,
    rating: str,
    reviewed: str,
    start,
    rev_date,
    name: str,
    valid_only: int | None = None,
) -> DataFrame:
    """Replace ratings in [start, revision] by what the revision's payment pattern says."""
    offset = F.col("__rev_reviewed") - F.col(reviewed) + 1
    seen = credit.pattern_at(F.col("__rev_pattern"), offset, valid_only)
    revised = F.when(
        F.col(date).between(F.lit(start), F.lit(rev_date)) & (F.col(rating) != seen), seen
    ).otherwise(F.col(rating))
    return (
        left_attach(df, facts, [id_col])
        .withColumn(name, revised)
        .drop("__rev_pattern", "__rev_reviewed")
    )


def deferral_adjust(
    df: DataFrame,
    id_col: str,
    date: str,
    rating: str,
    treated: Column,
    pre: tuple,
    window: tuple,
    post: tuple,
    name: str,
) -> DataFrame:
    """Call arrears current where they only occurred inside a relief window.

    Only accounts of the treated cohort that are bad before or after the window travel to the
    join: a thin slice of the panel, which AQE broadcasts when it is small enough.
    """
    day = F.col(date)
    bad = treated & credit.is_bad(F.col(rating))

    def within(span: tuple) -> Column:
        return day.between(F.lit(span[0]), F.lit(span[1]))

    lasting = (
        df.where(bad & (within(pre) | within(post)))
        .select(id_col)
        .distinct()
        .withColumn("__lasting", F.lit(1))
    )
    relieved = bad & within(window) & F.col("__lasting").isNull()
    return (
        left_attach(df, lasting, [id_col])
        .withColumn(name, F.when(relieved, "1").otherwise(F.col(rating)))
        .drop("__lasting")
    )


def first_location(
    df: DataFrame,
    id_col: str,
    date: str,
    columns: Sequence[str],
    required: Sequence[str],
    suffix: str,
) -> DataFrame:
    """Earliest known location per loan; a map-side combine leaves one row per loan."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    return (
        df.where(known)
        .groupBy(id_col)
        .agg(F.min_by(F.struct(*columns), F.col(date)).alias("__loc"))
        .select(id_col, *[F.col(f"__loc.{c}").alias(f"{c}{suffix}") for c in columns])
    )


def attach_first_location(
    df: DataFrame,
    id_col: str,
    date: str,
    columns: Sequence[str],
    required: Sequence[str],
    suffix: str,
) -> DataFrame:
    """Put the first known location of each loan on all of its rows."""
    return left_attach(df, first_location(df, id_col, date, columns, required, suffix), [id_col])
