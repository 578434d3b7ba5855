"""Account-level checks on adjusted ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creditloom.operators.reshape import pivot_measures


def rating_number(rating: str):
    """Rating code as a number; codes that are not digits give NULL."""
    return F.col(rating).try_cast("int")


def location_change(df: DataFrame, current: str, reported: str, name: str = "loc_chg") -> DataFrame:
    """1 where the adjusted and reported locations differ; an unknown on one side counts as different."""
    return df.withColumn(
        name, F.when(F.col(current).eqNullSafe(F.col(reported)), 0).otherwise(1)
    )


def rating_checks(
    df: DataFrame, id_col: str, date: str, raw: str, adjusted: str, at, then
) -> DataFrame:
    """Per account: was any rating adjusted, in arrears at ``at``, back below arrears at ``then``."""
    grade = rating_number(adjusted)
    changed = (F.col(adjusted) != F.col(raw)).cast("int")
    arrears = ((grade >= 4) & (F.col(date) == F.lit(at))).cast("int")
    recovered = ((grade < 4) & (F.col(date) == F.lit(then))).cast("int")
    return df.groupBy(id_col).agg(
        F.coalesce(F.max(changed), F.lit(0)).alias("check_mop"),
        F.coalesce(F.max(arrears), F.lit(0)).alias("check_arr"),
        F.coalesce(F.max(recovered), F.lit(0)).alias("check_recover"),
    )


def recovered_accounts(df: DataFrame, checks: DataFrame, id_col: str, date: str, span: tuple) -> DataFrame:
    """Rows in the span of the accounts that were in arrears and recovered."""
    recovered = checks.where((F.col("check_arr") == 1) & (F.col("check_recover") == 1))
    inside = df.where(F.col(date).between(F.lit(span[0]), F.lit(span[1])))
    return inside.join(recovered.select(id_col), id_col, "left_semi")


def arrears_pivot(
    df: DataFrame, date: str, rating: str, terminal: str, balance: str, id_col: str
) -> DataFrame:
    """Balances and account counts by date, good (0) and 90 days late (4), with the late rate."""
    bucket = F.when(rating_number(rating) >= 4, 4).otherwise(0)
    wide = pivot_measures(
        df.where(F.col(terminal) != "WO").withColumn("arr", bucket),
        date,
        "arr",
        [0, 4],
        {"balance": F.sum(balance), "n": F.count(id_col)},
    )
    good, late = F.col("balance_0"), F.col("balance_4")
    return wide.withColumn(
        "d90_rt", F.try_divide(F.lit(100.0) * late.cast("double"), (good + late).cast("double"))
    )
