"""Length of stay at an address and home ownership inferred from loans."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.operators.joins import left_attach


def stay_duration(
    df: DataFrame,
    id_col: str,
    location: Sequence[str],
    date: str,
    weight: Column,
    start: dt.date,
) -> DataFrame:
    """Weighted number of earlier periods at the same address, and whether it began with the data.

    Rows are first collapsed to one per (id, address, period), so a window partition holds at most
    as many rows as the calendar has periods, whatever the number of input rows.
    """
    periods = df.groupBy(id_col, *location, date).agg(F.count(F.lit(1)).alias("__n"))
    earlier = (
        Window.partitionBy(id_col, *location)
        .orderBy(date)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (id_col, *location)])
    weighted = F.sum(F.col("__n") * weight).over(earlier) * F.col("__n")
    began = F.min(date).over(earlier) == F.lit(start)
    return periods.select(
        id_col,
        *location,
        date,
        F.when(known, F.coalesce(weighted, F.lit(0))).otherwise(0).cast("long").alias("stay_dur"),
        F.when(known & began, 1).otherwise(0).alias("stay_censored"),
    )


def loan_anchors(
    loans: DataFrame, id_col: str, opened: str, closed: str, since: str, active: str
) -> DataFrame:
    """(consumer, month, kind): where to look up the address that belongs to a loan.

    Finished loans point 12 months after opening and 12 months before closing, active loans one
    month after they came on file.
    """
    done = F.col(active) == 0

    def anchor(when: Column, date: Column, kind: str) -> Column:
        return F.struct(
            F.when(when, F.trunc(date, "MM")).alias("month"), F.lit(kind).alias("kind")
        )

    options = F.array(
        anchor(done, F.add_months(opened, 12), "opened"),
        anchor(done, F.add_months(closed, -12), "closed"),
        anchor(F.col(active) == 1, F.add_months(since, 1), "active"),
    )
    return (
        loans.select(id_col, F.explode(options).alias("a"))
        .select(id_col, "a.month", "a.kind")
        .where(F.col("month").isNotNull())
        .distinct()
    )


def homeowner_inference(
    consumers: DataFrame,
    history: DataFrame,
    anchors: DataFrame,
    id_col: str,
    date: str,
    location: Sequence[str],
    balance: str,
    loan_counts: DataFrame | None = None,
) -> DataFrame:
    """Flag consumers with a mortgage balance, or living where one of their mortgages was held.

    The three kinds of anchors resolve to addresses in one join and one aggregation, so the
    consumer panel is joined once.  ``loan_counts`` (id, date, n_all_mrtg) adds the optional
    check column ``mrtg_null_refine``.
    """
    kinds = ("opened", "closed", "active")
    addresses = (
        history.select(id_col, F.trunc(date, "MM").alias("month"), *location)
        .join(anchors, [id_col, "month"])
        .groupBy(id_col, *location)
        .agg(*[F.max((F.col("kind") == k).cast("int")).alias(f"fsa_{k}") for k in kinds])
    )
    flags = [f"fsa_{k}" for k in kinds]
    out = left_attach(consumers, addresses, [id_col, *location]).fillna(0, subset=flags)
    owns = F.when(F.col(balance) > 0, 1).when(
        (F.col(balance) == 0) & (F.greatest(*flags) > 0), 1
    )
    out = out.withColumn("homeowner_mrtg", owns.otherwise(0))
    if loan_counts is not None:
        out = left_attach(out, loan_counts, [id_col, date]).withColumn(
            "mrtg_null_refine",
            F.when((F.col("homeowner_mrtg") == 1) & F.col("n_all_mrtg").isNull(), "Y").otherwise("N"),
        )
    return out


def homeowner(line_count: Column, mortgage_flag: Column) -> Column:
    """Owner by mortgage or by holding a home-equity line."""
    return F.when((F.coalesce(line_count, F.lit(0)) > 0) | (mortgage_flag == 1), 1).otherwise(0)
