"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from creditloom.llm import (
    disclosure, forest, hard_negatives, huffman, level_packing, license_markup, packing, page_template, quality, simhash_bk, tiling, toxicity, turn_repair,
)
from creditloom.llm.base import ready
from creditloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_huffman")
def op2(spark, sf_dir):
    path = scratch_path(spark, "coded")
    huffman.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return huffman.read(spark, path, {"ids_crc32": F.crc32("ids")})


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# All pairs, and reachability by recursion: for the small tables of the comparison.
ALL_PAIRS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9 AND NOT isnan(list_cosine_similarity(a.e, b.e))),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN counted ON counted.a = v.vec_id
"""


@query("op4_forest", ALL_PAIRS)
def op4(spark, sf_dir):
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_quality")
def op5(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_tiling")
def op6(spark, sf_dir):
    found = tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "n_words", F.lit(True).alias("contaminated"))


@query("op7_disclosure")
def op7(spark, sf_dir):
    return disclosure.report(table(spark, sf_dir, "documents"))


@query("op8_license_markup")
def op8(spark, sf_dir):
    return license_markup.report(table(spark, sf_dir, "documents"))


@query("op9_page_template")
def op9(spark, sf_dir):
    return page_template.extract(table(spark, sf_dir, "pages"))


@query("op10_simhash")
def op10(spark, sf_dir):
    return simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_levels")
def op12(spark, sf_dir):
    return level_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# Every anchor against every row, in whole numbers.
ANCHORS_BY_ROWS = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_segments", ANCHORS_BY_ROWS)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        hard_negatives.quantised().alias("embedding"),
    )
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op11_run_lengths")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    damaged = rows.withColumn("damage", F.crc32(named.cast("binary")) % 20).select(
        "conv_id",
        "turn",
        "damage",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
    )
    return turn_repair.report(
        damaged, live=F.col("damage") != 0, copies=F.when(F.col("damage") == 3, 2).otherwise(1)
    )
