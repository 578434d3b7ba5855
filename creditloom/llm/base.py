"""What the text operators share: input columns under names of our own, small Arrow batches, sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creditloom.session import tune

# Rows of text per Arrow batch. Long texts make large rows, so a batch holds few of them.
TEXT_ROWS_PER_BATCH = "256"


def ready(spark: SparkSession) -> SparkSession:
    """Runtime settings for text work: AQE with skew handling, small batches to Python workers."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS_PER_BATCH)
    return spark


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) under the names ``__id`` and ``__text``: other columns cannot clash, a null text is empty."""
    ready(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Run ``fn`` over the rows of a partition, as tuples, in Arrow batches of bounded size.

    ``fn`` gets an iterator over batches; a batch is a list of columns (Python lists). It yields lists of
    columns in the order of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        columns = ([c.to_pylist() for c in batch.columns] for batch in batches)
        for made in fn(columns):
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(made, out)], schema=out
            )

    return df.mapInArrow(run, schema)


def crc_mod(key: Column, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``: the fixed fold of a row."""
    return F.crc32(key.cast("string").cast("binary")) % parts
