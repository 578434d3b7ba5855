"""Readers and writers for the monthly files, lookups and result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from creditloom.functions.dates import MONTH, Step


def scan_panel(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str | Column] = ("*",),
    where: Column | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """One scan over many Parquet files (Hadoop globs), pruned and filtered at the source."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, typed by declaration instead of inference."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def save(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, optionally partitioned so that later scans can prune."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_csv_single(df: DataFrame, path: str) -> None:
    """One CSV file with a header.  For region-level results only: their size does not follow the data."""
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def read_region_panel(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return scan_csv(spark, path, schema)


def ingest_with_warmup(
    df: DataFrame,
    date: str,
    start: dt.date,
    derive: Callable[[DataFrame], DataFrame],
    end: dt.date | None = None,
    warmup: int = 1,
    step: Step = MONTH,
) -> DataFrame:
    """Run a lagged derivation over [start, end) with earlier periods as context, then trim them."""
    first = step.shift(F.lit(start), -warmup)
    loaded = df.where(F.col(date) >= first)
    if end is not None:
        loaded = loaded.where(F.col(date) < F.lit(end))
    return derive(loaded).where(F.col(date) >= F.lit(start))


# The partition column of loaded tables: the first day of a row's period.
PERIOD = "__period"


def _with_period(df: DataFrame, date: str, step: Step) -> DataFrame:
    return df.withColumn(PERIOD, F.date_format(step.floor(F.col(date)), "yyyy-MM-dd"))


def _put(df: DataFrame, path: str) -> None:
    """Replace exactly the periods that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(path)


def read_loaded(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A loaded table, with its period as text; an empty one is fine."""
    return spark.read.schema(StructType([*schema.fields]).add(PERIOD, "string")).parquet(path)


def load_range(
    rows: DataFrame,
    table: str,
    state: str,
    date: str,
    start: dt.date,
    end: dt.date,
    derive: Callable[[DataFrame], DataFrame],
    warmup: int = 1,
    step: Step = MONTH,
) -> None:
    """Load the periods of [start, end) into a table partitioned by period, from their own rows and a stored state only.

    A derivation that looks back ``warmup`` periods needs the last of them before ``start`` as context. Each load keeps its own
    last periods, as they came, in the state table, so the next one reads these and not the history. Both tables are
    overwritten by period: a load that runs again, also an old one after newer ones, or one that failed half way, leaves what a
    single run leaves. Loads come in order the first time; a first load has no context. A period that had rows
    and has none any more is not touched. Rows without a date belong to no period.
    """
    spark = rows.sparkSession
    first, last = F.lit(start), F.lit(end)
    new = rows.where((F.col(date) >= first) & (F.col(date) < last))
    # Makes the state readable before the first load; an existing one stays as it is.
    _with_period(rows.limit(0), date, step).write.mode("ignore").partitionBy(PERIOD).parquet(state)
    since = F.date_format(step.floor(step.shift(first, -warmup)), "yyyy-MM-dd")
    before = read_loaded(spark, state, rows.schema).where(
        (F.col(PERIOD) >= since) & (F.col(PERIOD) < F.date_format(step.floor(first), "yyyy-MM-dd"))
    )
    derived = derive(before.drop(PERIOD).unionByName(new)).where(F.col(date) >= first)
    _put(_with_period(derived, date, step), table)
    _put(_with_period(new.where(F.col(date) >= step.shift(last, -warmup)), date, step), state)
