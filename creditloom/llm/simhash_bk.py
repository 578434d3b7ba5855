"""SimHash near duplicates: fingerprints, and BK-trees over shards that hold every close pair together.

Two 64-bit fingerprints that differ in at most two bits agree on one of three blocks of bits. So a shard is one
value of one block: every linked pair meets in a shard, and no tree has to hold, or travel with, all fingerprints.
Shards beyond ``SHARD_ROWS`` take an exact way that needs no group at all: two fingerprints at distance one or two
have a common neighbour at distance at most one.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import map_rows, texts
from creditloom.llm.graph import components
from creditloom.session import cut_lineage

WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
SHARD_ROWS = 192
# Shingles hashed and summed at a time, so that a long text needs bounded memory.
CHUNK = 65_536
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _fingerprint(text: str) -> int:
    """The signed 64-bit fingerprint of the whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    span = min(WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - span + 1].tolist()
    stops = (ends[span - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, total, CHUNK):
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], dtype="<u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a signed long per row, zero for a text without words."""

    def run(batches):
        for ids, bodies in batches:
            yield [ids, [_fingerprint(body) for body in bodies]]

    return map_rows(texts(docs, key, text), run, "doc_id long, fp long")


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Values in the tree within the radius; only edges that can lead there are followed."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            at = todo.pop()
            distance = (self.nodes[at] ^ value).bit_count()
            if distance <= radius:
                found.append(self.nodes[at])
            todo += [child for edge, child in self.children[at].items() if abs(edge - distance) <= radius]
        return found

    def add(self, value: int) -> None:
        at, new = 0, len(self.nodes)
        while at < new:
            distance = (self.nodes[at] ^ value).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                break
            at = self.children[at][distance]
        self.nodes.append(value)
        self.children.append({})


def _shard_links(batches):
    """Spanning links of every shard: each fingerprint asks the tree of those before it."""
    for (shards,) in batches:
        left, right = [], []
        for shard in shards:
            tree, parent = BKTree(), {}

            def root(x):
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for value in shard:
                unsigned = value & 0xFFFFFFFFFFFFFFFF
                parent[unsigned] = unsigned
                for other in tree.near(unsigned, RADIUS):
                    a, b = root(unsigned), root(other)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                tree.add(unsigned)
            for value in shard:
                top = root(value & 0xFFFFFFFFFFFFFFFF)
                top -= (top >> 63) << 64
                if top != value:
                    left.append(value)
                    right.append(top)
        yield [left, right]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that span every group within the radius."""
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("block"),
                        F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)).alias("value"),
                    )
                    for i, (first, bits) in enumerate(BLOCKS)
                ]
            )
        ).alias("k"),
    ).select("fp", "k.block", "k.value")
    sizes = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut_lineage(keyed.join(sizes, ["block", "value"]))
    shards = shared.filter(F.col("n") <= SHARD_ROWS).groupBy("block", "value").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    from_trees = map_rows(shards.select("fps"), _shard_links, "a long, b long")
    crowded = shared.filter(F.col("n") > SHARD_ROWS).select("fp").distinct()
    flips = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    around = crowded.select("fp", F.explode(flips).alias("middle"))
    # At most 65 fingerprints are within distance one of a middle, so these lists are bounded.
    met = around.groupBy("middle").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    from_middles = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return from_trees.union(from_middles)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and are handled as one; a
    repeated row comes out as often as it goes in. component_id is the smallest id reachable by links (null only
    if all ids of the group are null). An empty table gives no rows.
    """
    rows = cut_lineage(fingerprints(docs, key, text))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct))
    grouped = groups.join(distinct, groups["node"] == distinct["fp"]).select("fp", "component", "least")
    least = grouped.groupBy("component").agg(F.min("least").alias("group_least"))
    linked = grouped.join(least, "component").select("fp", "group_least")
    # Written first: a join of two tables is one whose hot fingerprint AQE can split.
    of_fp = cut_lineage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("group_least", "least").alias("component_id")))
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, in their own columns, whose id is the smallest of their group; repeated rows stay once.

    Ids, not rows, are kept: texts under a kept id all stay, once each. Documents without an id cannot be named and stay.
    Only ids that go or repeat meet the documents, so texts are not shuffled where those are few.
    """
    found = near_duplicates(docs, key, text).filter("doc_id is not null")
    fate = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), F.count("*").alias("n"))
    special = cut_lineage(fate.filter("not kept or n > 1").select(F.col("doc_id").alias("__special"), "kept"))
    named = F.col(key) == F.col("__special")
    repeated = docs.join(special.filter("kept"), named, "left_semi").dropDuplicates([key, text])
    return docs.join(special, named, "left_anti").union(repeated)
