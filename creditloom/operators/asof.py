"""Point-in-time reconstruction of account histories from late reports.

An account's history is cut into calendar blocks. A row goes to every block in which its report can serve a reference
period or in which it creates one, which is a single block but near a boundary, so that one exchange by (account, block)
is all that matching and re-dating need, and a very long history is spread over tasks. Everything after it are windows
within a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.functions.dates import MONTH, Step

# Periods per block of one account's history.
BLOCK = 64


def reference_dates(
    df: DataFrame, id_col: str, run: str, reported: str, step: Step = MONTH, name: str = "ref_date"
) -> DataFrame:
    """Distinct (id, reference period): the period after each report and the period of each run."""
    after_report = step.floor(step.shift(F.col(reported), 1))
    periods = F.explode(F.array(after_report, step.floor(F.col(run))))
    return df.select(id_col, periods.alias(name)).distinct()


def latest_run(df: DataFrame, id_col: str, run: str, reported: str) -> DataFrame:
    """The last run that carried each report."""
    return df.groupBy(id_col, reported).agg(F.max(run).alias("last_run_date"))


def _block(period: Column) -> Column:
    return F.floor(period / BLOCK)


def _in_blocks(
    df: DataFrame, id_col: str, run: str, reported: str, lookback: int, step: Step
) -> DataFrame:
    """Rows with __report and __run (period numbers), once per block that they matter to."""
    report, ran = step.index(F.col(reported)), step.index(F.col(run))
    places = [report + k for k in range(max(lookback, 1) + 1)] + [ran]
    blocks = F.array_distinct(F.array_compact(F.array(*[_block(p) for p in places])))
    return df.select(
        *df.columns,
        report.alias("__report"),
        ran.alias("__run"),
        # A report within its period does not serve the start of that period.
        (F.col(reported) > step.floor(F.col(reported))).alias("__late"),
        F.explode(blocks).alias("__block"),
    )


def asof_latest_report(
    df: DataFrame,
    id_col: str,
    run: str,
    reported: str,
    lookback: int = 3,
    step: Step = MONTH,
    name: str = "ref_date",
) -> DataFrame:
    """(id, reference period) → latest run whose report lies within the lookback.

    After the exchange every row lists its report and the two reference periods it creates; one range
    frame over them, in the order of their dates, holds exactly the reports that a period looks back on.
    Run and reference dates are period starts.
    """
    narrow = df.select(id_col, run, reported)
    # The exchange comes before the rows are expanded; the window and the grouping reuse it.
    placed = _in_blocks(narrow, id_col, run, reported, lookback, step).repartition(id_col, "__block")
    created = [(step.floor(step.shift(F.col(reported), 1)), F.col("__report") + 1), (step.floor(F.col(run)), F.col("__run"))]
    nothing = F.lit(None).cast(df.schema[run].dataType)
    # Twice the period, and one more for a report within it: period starts see only reports up to them.
    entries = F.array(
        F.struct((2 * F.col("__report") + F.col("__late").cast("int")).alias("at"), F.col(run).alias("r"), nothing.cast("date").alias("ref"), F.lit(False).alias("wanted")),
        *[F.struct((2 * p).alias("at"), nothing.alias("r"), ref.cast("date").alias("ref"), (_block(p) == F.col("__block")).alias("wanted")) for ref, p in created],
    )
    back = Window.partitionBy(id_col, "__block").orderBy("at").rangeBetween(-2 * lookback, 0)
    seen = placed.select(id_col, "__block", F.explode(entries).alias("e")).select(id_col, "__block", "e.*")
    return (
        seen.where(F.col("at").isNotNull())
        .withColumn("select_run_date", F.max("r").over(back))
        .where("wanted")
        .groupBy(id_col, "__block", F.col("ref").alias(name))
        .agg(F.max("select_run_date").alias("select_run_date"))
        .drop("__block")
    )


def rebuild_as_of(
    df: DataFrame,
    id_col: str,
    run: str,
    reported: str,
    terminal: str,
    lookback: int = 3,
    step: Step = MONTH,
    name: str = "ref_date",
) -> DataFrame:
    """Account rows re-dated to reference periods; repeats of paid accounts are dropped.

    A row stands for a period if its own report lies within the lookback, no such report was carried by a
    later run, and the account has that period as a reference. Rows look at the periods around their report
    through range frames, so matching needs no join back: one exchange carries the rows, and they are only
    repeated for the periods that they do stand for. A row without an id has no history.
    """
    known = df.where(F.col(id_col).isNotNull())
    placed = _in_blocks(known, id_col, run, reported, lookback, step)
    history = Window.partitionBy(id_col, "__block")
    by_report = history.orderBy("__report")

    def within(first: int, last: int) -> Window:
        return by_report.rangeBetween(first, last)

    runs = {"__runs": F.collect_set("__run").over(history)}
    for k in range(lookback + 1):
        # Whole periods of the lookback, and reports at the very start of the period itself.
        runs[f"__best_{k}"] = F.max(run).over(within(k - lookback, k - 1)) if lookback else F.lit(None)
        runs[f"__start_{k}"] = F.max(F.when(~F.col("__late"), F.col(run))).over(within(k, k))
        runs[f"__made_{k}"] = F.count("__report").over(within(k - 1, k - 1)) > 0
    served = F.array(
        *[
            F.when(
                (~F.col("__late") if k == 0 else F.lit(True))
                & (_block(F.col("__report") + k) == F.col("__block"))
                & (F.col(run) == F.greatest(f"__best_{k}", f"__start_{k}"))
                & (F.col(f"__made_{k}") | F.array_contains("__runs", F.col("__report") + k)),
                step.shift(step.floor(F.col(reported)), k),
            )
            for k in range(lookback + 1)
        ]
    )
    dated = placed.withColumns(runs).withColumn(name, F.explode(F.array_compact(served)))
    stale_paid = (F.col(name) >= step.shift(F.col(reported), 1)) & (F.col(terminal) == "PD")
    others = [c for c in df.columns if c not in (id_col, run)]
    return dated.where(~stale_paid).select(id_col, run, *others, name)
