"""Ids, ranking, sampling, pivots, spells and base-period indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.functions.dates import MONTH, Step
from creditloom.session import cut_lineage


def unit_ids(df: DataFrame, name: str, id_name: str = "unit_id") -> DataFrame:
    """Dense ids 1…n in sorted name order, without sorting everything in one task.

    Names are dealt to tasks by ranges of their order and numbered within each; a range then starts at the
    number of names before it, a running sum over one row per task. Ranges follow the names that there are, so a prefix that
    many names share is split like any other. The numbered names are written, as both steps must see the same ranges.
    """
    names = df.select(name).dropna().distinct()
    placed = names.repartitionByRange(name).sortWithinPartitions(name)
    # Row numbers of a task start at its number times 2^33.
    numbered = cut_lineage(placed.withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33).alias("__task")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy(task).agg(F.count(F.lit(1)).alias("__n")).select(
        "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    rank = F.col("__at") - F.shiftleft("__task", 33) + 1
    return numbered.withColumn("__task", task).join(offsets, "__task").select(
        name, (rank + F.col("__offset")).cast("int").alias(id_name)
    )


def top_k_per_group(
    df: DataFrame, group: Sequence[str], weight: str, tie: str, k: int = 5
) -> DataFrame:
    """The k largest positive weights per group; Spark prunes to k per task before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(weight), F.asc(tie))
    return (
        df.where(F.col(weight) > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def donor_pool(units: DataFrame, name: str, excluded: DataFrame) -> DataFrame:
    """Units that are neither treated nor dropped."""
    return units.select(name).distinct().join(excluded.select(name), name, "left_anti")


def sample_entities(df: DataFrame, id_col: str, fraction: float, seed: int) -> DataFrame:
    """All rows of a fixed share of ids.

    The draw is the first eight hex digits of md5("id-seed"), so it depends neither on the layout
    nor on the engine.  A NULL id is in no sample, unless the sample is everything.
    """
    digest = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    if fraction >= 1:
        return df
    return df.where(F.col(id_col).isNotNull() & (draw < int(round(fraction * 2**32))))


def cohort_extract(
    df: DataFrame, id_col: str, predicate: Column, fraction: float = 1.0, seed: int = 0
) -> DataFrame:
    """All rows of a (sampled) cohort: the ids that satisfy the predicate anywhere."""
    cohort = df.where(predicate).select(id_col).distinct()
    return df.join(sample_entities(cohort, id_col, fraction, seed), id_col, "left_semi")


def pivot_measures(
    df: DataFrame, key: str, column: str, values: Sequence, measures: dict[str, Column]
) -> DataFrame:
    """Long to wide over a known code list: columns are named ``<measure>_<code>``."""
    wide = df.groupBy(key).pivot(column, list(values)).agg(
        *[m.alias(name) for name, m in measures.items()]
    )
    if len(measures) == 1:
        only = next(iter(measures))
        return wide.withColumnsRenamed({str(v): f"{only}_{v}" for v in values})
    return wide.withColumnsRenamed(
        {f"{v}_{name}": f"{name}_{v}" for v in values for name in measures}
    )


def spells(df: DataFrame, id_col: str, date: str, step: Step = MONTH) -> DataFrame:
    """Runs of consecutive periods per id: number, start, end, length, and the id's number of runs.

    Input rows collapse to distinct (id, period) first, so one window partition is bounded by the
    calendar.
    """
    per_id = Window.partitionBy(id_col).orderBy("__t")
    periods = (
        df.select(id_col, date).distinct().withColumn("__t", step.index(F.col(date)))
    )
    runs = (
        periods.withColumn("__run", F.col("__t") - F.row_number().over(per_id))
        .groupBy(id_col, "__run")
        .agg(
            F.min(date).alias("spell_start"),
            F.max(date).alias("spell_end"),
            F.count(F.lit(1)).alias("spell_length"),
        )
    )
    order = Window.partitionBy(id_col).orderBy("spell_start")
    return runs.select(
        id_col,
        F.row_number().over(order).alias("spell"),
        "spell_start",
        "spell_end",
        "spell_length",
        F.count(F.lit(1)).over(Window.partitionBy(id_col)).alias("max_spell"),
    )


def index_to_base(
    df: DataFrame, group: Sequence[str], date: str, base, measures: Sequence[str], suffix: str = "_norm"
) -> DataFrame:
    """Each measure of a (group, date) panel divided by its value at the group's base date.

    A window group holds one row per date, so it is bounded by the calendar.
    """
    per_group = Window.partitionBy(*group)

    def at_base(measure: str) -> Column:
        return F.max(F.when(F.col(date) == F.lit(base), F.col(measure))).over(per_group)

    return df.withColumns(
        {f"{m}{suffix}": F.try_divide(F.col(m), at_base(m)) for m in measures}
    )


def freq_table(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
