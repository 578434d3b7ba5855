"""Semi joins, enrichment and merges.

Skew: every equi join here may meet a key that owns a large part of the rows.  Matching rows
rely on AQE's skew split (``session.RUNTIME_CONF``), which cuts one hot partition into many
tasks.  NULL keys never match but still hash to one place; ``spread_nulls`` salts them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NULL_SALTS = 256


def keep_ever(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    """Rows whose key appears among the members."""
    return df.join(members.select(key), key, "left_semi")


def flag_ever(df: DataFrame, key: str, predicate: Column, name: str) -> DataFrame:
    """1 on all rows of a key that satisfies the predicate anywhere in its history."""
    hits = df.where(predicate).select(key).distinct().withColumn(name, F.lit(1))
    return left_attach(df, hits, [key]).fillna(0, subset=[name])


def left_attach(
    df: DataFrame, facts: DataFrame, keys: Sequence[str], spread_nulls: bool = False
) -> DataFrame:
    """Left join on equally named keys.

    Successive calls on the same keys keep one partitioning, so the left side shuffles once.
    ``spread_nulls`` is for keys that are often NULL: such rows cannot match but would all hash to
    one task.  The salt is a hash of the row, not a random number, so a retried task repeats it.
    """
    extra = [c for c in facts.columns if c not in keys]
    if not spread_nulls:
        return df.join(facts, list(keys), "left").select(*df.columns, *extra)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    row_hash = F.pmod(F.xxhash64(*df.columns), F.lit(NULL_SALTS)) + 1
    salted = df.withColumn("__salt", F.when(missing, row_hash).otherwise(F.lit(0)))
    right = facts.withColumn("__salt", F.lit(0).cast("long"))
    joined = salted.join(right, [*keys, "__salt"], "left")
    return joined.select(*df.columns, *extra)


# A broadcast table is held in full by the driver and every executor.
BROADCAST_BYTES = 64 << 20


def checked_broadcast(
    lookup: DataFrame, max_rows: int = 1_000_000, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast a lookup whose rows and bytes are measured; a larger one goes through an ordinary join.

    Measuring runs the lookup once, so pass a materialised one.
    """
    texts = [f.name for f in lookup.schema.fields if f.dataType.simpleString() == "string"]
    fixed = sum(16 for f in lookup.schema.fields)
    width = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.octet_length(t).cast("long"), F.lit(0)) for t in texts],
        F.lit(fixed).cast("long"),
    )
    rows, size = lookup.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(lookup) if rows <= max_rows and size <= max_bytes else lookup


def enrich(df: DataFrame, dimension: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Attach dimension columns; ``how='inner'`` also drops rows the dimension does not know."""
    return left_attach(df, dimension, on) if how == "left" else df.join(dimension, list(on), how)


def translate_key(
    df: DataFrame, mapping: DataFrame, key: str, target: str, repeats: str
) -> DataFrame:
    """Map a key through the unambiguous part of a lookup table.

    No broadcast hint: AQE broadcasts the lookup if its measured bytes are few, and joins otherwise.
    """
    unique = mapping.where(F.col(repeats) < 2).select(key, target)
    return left_attach(df, unique, [key], spread_nulls=True)


def join_same_month(
    df: DataFrame, date: str, facts: DataFrame, facts_date: str, keys: Sequence[str]
) -> DataFrame:
    """Left join on keys and calendar month; both sides hash on the month start."""
    month = "__month"
    left = df.withColumn(month, F.trunc(date, "MM"))
    right = facts.withColumn(month, F.trunc(facts_date, "MM")).drop(facts_date)
    return left_attach(left, right, [*keys, month]).drop(month)


def full_merge(
    left: DataFrame, right: DataFrame, keys: Sequence[str], shared: Sequence[str] = ()
) -> DataFrame:
    """Full outer join; keys and shared attributes come from whichever side has them; zero fill.

    A left join and the right side's remainder in place of a full join: AQE splits a hot key of either,
    but never one of a full outer join. A NULL key never matches, so such rows of both sides survive separately.
    """
    a, b = left.alias("a"), right.alias("b")
    condition = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    named = {*keys, *shared}
    own_a = [c for c in left.columns if c not in named]
    own_b = [c for c in right.columns if c not in named]
    matched = a.join(b, condition, "left").select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in shared],
        *[F.col(f"a.{c}") for c in own_a],
        *[F.col(f"b.{c}") for c in own_b],
    )
    rest = b.join(left.select(*keys).alias("a"), condition, "left_anti")
    remainder = rest.select(
        *[F.col(f"b.{c}") for c in [*keys, *shared]],
        *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own_a],
        *[F.col(f"b.{c}") for c in own_b],
    )
    return matched.unionByName(remainder).fillna(0)


def merge_products(
    base: DataFrame,
    products: Mapping[str, DataFrame],
    keys: Sequence[str],
    fill_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Left join one frame per product, with an ``<name>_exist`` flag each, then zero fill.

    The default fill covers every numeric column of the result, base columns included: a missing
    score counts as 0 from here on.  ``fill_cols`` restricts it.
    """
    out = base
    for name, product in products.items():
        out = left_attach(out, product.withColumn(f"{name}_exist", F.lit(1)), keys)
    flags = [f"{name}_exist" for name in products]
    if fill_cols is None:
        return out.fillna(0)
    return out.fillna(0, subset=[*fill_cols, *flags])


def flag_sites(df: DataFrame, sites: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """1 where the keys are listed among the sites."""
    listed = sites.select(*keys).distinct().withColumn(name, F.lit(1))
    return left_attach(df, listed, keys).fillna(0, subset=[name])


def address_override(
    df: DataFrame,
    key: str,
    date: str,
    columns: Sequence[str],
    anchor: Column,
    inside: Column,
    window: tuple,
    flag: str,
    suffix: str = "_reported",
) -> DataFrame:
    """Give a cohort its address at the anchor date throughout a displacement window.

    The cohort is everybody inside the area at the anchor date.  Rows in the window that lie
    outside the area take the anchor address; reported columns are kept under ``suffix``.
    ``inside`` is a predicate over the address columns.
    """
    anchored = {c: f"__anchor_{c}" for c in columns}
    cohort = (
        df.where(anchor & inside)
        .select(key, *[F.col(c).alias(a) for c, a in anchored.items()])
        .withColumn(flag, F.lit(1))
    )
    out = left_attach(df, cohort, [key]).fillna(0, subset=[flag])
    moved = (F.col(flag) == 1) & ~inside & F.col(date).between(*window)
    out = out.withColumns(
        {
            f"__adj_{c}": F.when(moved, F.col(a)).otherwise(F.col(c))
            for c, a in anchored.items()
        }
    ).drop(*anchored.values())
    return out.withColumnsRenamed(
        {**{c: c + suffix for c in columns}, **{f"__adj_{c}": c for c in columns}}
    )
