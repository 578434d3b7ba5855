"""Account status from the previous period, and counts sent back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from creditloom.functions.dates import MONTH, Step
from creditloom.operators.joins import left_attach


# Periods per block of one account's history.
BLOCK = 64


def prev_period_status(
    df: DataFrame,
    id_col: str,
    date: str,
    balance: str,
    charged: str,
    closed_flag: str,
    account_type: str | None,
    opened: str | None,
    step: Step = MONTH,
    opened_within: int = 6,
) -> DataFrame:
    """Add new_file, terminal and chargoff_new, and drop accounts already paid before.

    The previous period is a window frame of exactly that period: one scan and one shuffle, where a
    self join does both twice.  Like the join, it gives a row per match, so repeated (id, period)
    rows lose nothing.  Histories are cut into blocks of BLOCK periods, and the last period of a
    block is copied ahead of the next one, so that even a very long history of one account is
    spread over tasks.
    """
    last = F.struct(
        F.col(date).alias("date"),
        F.col(balance).alias("bal"),
        F.col(charged).alias("chg"),
        F.col(closed_flag).alias("closed"),
        (F.col(account_type) if account_type else F.lit(None).cast("string")).alias("type"),
    )
    period = step.index(F.col(date))
    closes_block = F.pmod(period, F.lit(BLOCK)) == BLOCK - 1
    copies = F.when(closes_block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    blocked = df.select(
        *df.columns,
        # A row without an id has no past; its hash keeps such rows from sharing one group.
        F.when(F.col(id_col).isNull(), F.xxhash64(*df.columns)).otherwise(0).alias("__salt"),
        F.explode(copies).alias("__copy"),
    ).withColumns({"__block": F.floor((period + F.col("__copy")) / BLOCK), "__period": period})
    before = Window.partitionBy(id_col, "__block", "__salt").orderBy("__period").rangeBetween(-1, -1)
    matches = F.filter("__matches", lambda m: m["date"] == step.shift(F.col(date), -1))
    joined = (
        blocked.withColumn("__matches", F.collect_list(last).over(before))
        .where(F.col("__copy") == 0)
        .withColumn("__last", F.explode_outer(matches))
    )
    adjacent = F.col("__last").isNotNull()

    bal, chg = F.col(balance), F.col(charged)
    instalment = F.col(account_type).isin("M", "I") if account_type else F.lit(False)
    first_seen = ~adjacent
    recently_opened = (
        F.col(opened) >= step.shift(F.col(date), -opened_within) if opened else F.lit(False)
    )
    new_file = (
        F.when(~first_seen, "exist").when(recently_opened, "new").otherwise("legacy")
    )
    written_off = (bal > 0) & (chg >= bal)
    terminal = (
        F.when((bal == 0) & ((F.col(closed_flag) == "Y") | instalment), "PD")
        .when(written_off, "WO")
        .when((bal > 0) & (F.col(closed_flag) == "Y"), "AC")
        .otherwise("N")
    )
    # Unknown last status (first appearance) does not count as a transition.
    was_written_off = (F.col("__last.bal") > 0) & (F.col("__last.chg") >= F.col("__last.bal"))
    chargoff_new = F.when(adjacent & ~was_written_off & written_off, chg).otherwise(0)

    was_instalment = F.col("__last.type").isin("M", "I") if account_type else F.lit(False)
    paid_before = ((F.col("__last.bal") == 0) & (bal == 0)) & (
        (F.col("__last.closed") == "Y") | was_instalment
    )
    out = joined.withColumns(
        {
            "new_file": new_file,
            "terminal": terminal,
            "chargoff_new": chargoff_new.cast(df.schema[charged].dataType),
        }
    )
    return out.where(
        (first_seen | ~paid_before)
        & ~((F.col("new_file") == "legacy") & (F.col("terminal") == "PD"))
    ).select(*df.columns, "new_file", "terminal", "chargoff_new")


def with_group_size(
    df: DataFrame, keys: Sequence[str], counted: str, name: str
) -> DataFrame:
    """Number of non-NULL ``counted`` values per group on every row; NULL where a key is NULL."""
    sizes = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(counted).alias(name))
    return left_attach(df, sizes, keys, spread_nulls=True)
