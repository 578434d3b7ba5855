"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits by a random direction per level at the node's median; rows within a margin of the cut go to both
sides (spill). The cuts come from a bounded sample, deeper ones from the centre and the margin of the last fitted node, so
the depth follows the number of rows while the model stays small. Trees are added until ``RECALL`` of trial pairs at the
threshold meet, so their number follows the depth. Vectors that share a leaf of any tree are compared in
double precision, whole leaf against whole leaf; a pair counts only in the first leaf that both are in, so links are counted
without ever being listed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import map_rows, ready
from creditloom.llm.graph import components
from creditloom.session import cut_lineage

THRESHOLD = 0.9
# At least this share of pairs just at the threshold shares a leaf; the fewest and the most trees for it, and the pairs tried.
RECALL = 0.97
TREES = 6
MOST_TREES = 64
TRIAL_PAIRS = 1_024
SPILL = 0.12
LEAF_ROWS = 256
# Vectors that the cuts are fitted on, and the fewest of them that make a median.
SAMPLE_ROWS = 16_384
FIT_ROWS = 24
# Rows compared in one task group; a larger leaf is compared block by block.
BLOCK_ROWS = 384
SEED = 20


class Tree:
    """Directions per level, cuts and margins per node; node 1 is the root, 2n and 2n + 1 are below n."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((depth, sample.shape[1]))
        self.cuts: dict[int, tuple[float, float, float]] = {}
        # Centre of the rows, and the margins below and above a cut in units of the direction's length.
        self.centres: dict[int, tuple[np.ndarray, float, float]] = {}
        self.lengths = np.linalg.norm(self.directions, axis=1)
        self._fit(sample, 1, 0, depth, 0.0, 0.0)

    def _fit(self, rows: np.ndarray, node: int, level: int, depth: int, under: float, over: float) -> None:
        if level == depth:
            return
        if len(rows) < FIT_ROWS:
            self.centres[node] = rows.mean(axis=0) if len(rows) else np.zeros(self.directions.shape[1]), under, over
            return
        at = rows @ self.directions[level]
        low, middle, high = np.quantile(at, [0.5 - SPILL / 2, 0.5, 0.5 + SPILL / 2])
        self.cuts[node] = (low, middle, high)
        under, over = (middle - low) / self.lengths[level], (high - middle) / self.lengths[level]
        self._fit(rows[at <= middle], 2 * node, level + 1, depth, under, over)
        self._fit(rows[at > middle], 2 * node + 1, level + 1, depth, under, over)

    def cut(self, node: int, level: int) -> tuple[float, float, float]:
        if node in self.cuts:
            return self.cuts[node]
        above = node
        while above not in self.centres and above > 1:
            above >>= 1
        centre, under, over = self.centres[above]
        middle, length = float(centre @ self.directions[level]), float(self.lengths[level])
        return middle - under * length, middle, middle + over * length

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a row near a cut has several leaves."""
        row, node = np.arange(len(rows)), np.ones(len(rows), dtype=np.int64)
        for level, direction in enumerate(self.directions):
            at = (rows @ direction)[row]
            nodes, which = np.unique(node, return_inverse=True)
            cuts = np.array([self.cut(int(n), level) for n in nodes]).reshape(-1, 3)[which]
            left, right = at <= np.maximum(cuts[:, 2], cuts[:, 1]), at >= cuts[:, 0]
            right &= ~((cuts[:, 0] == cuts[:, 2]) & left)
            row = np.concatenate((row[left], row[right]))
            node = np.concatenate((2 * node[left], 2 * node[right] + 1))
        return row, node


def _meet(tree: Tree, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Per pair of rows, whether some leaf holds both."""
    leaves: list[set[int]] = [set() for _ in range(2 * len(one))]
    for row, leaf in zip(*(a.tolist() for a in tree.leaves(np.vstack((one, two))))):
        leaves[row].add(leaf)
    return np.array([not a.isdisjoint(b) for a, b in zip(leaves[: len(one)], leaves[len(one) :])], dtype=bool)


def grow(sample: np.ndarray, rows: int) -> list[Tree]:
    """The forest for a number of rows: trees until ``RECALL`` of pairs of a sampled row and one at the threshold's angle meet."""
    depth = max(0, math.ceil(math.log2(rows / LEAF_ROWS)))
    rng = np.random.default_rng(SEED)
    one = sample[rng.permutation(len(sample))[:TRIAL_PAIRS]]
    if depth == 0 or sample.shape[1] < 2:
        return [Tree(sample, depth, SEED + t) for t in range(TREES)]
    away = rng.standard_normal(one.shape)
    away -= (away * one).sum(axis=1, keepdims=True) * one
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    two = THRESHOLD * one + math.sqrt(1 - THRESHOLD**2) * away
    forest: list[Tree] = []
    met = np.zeros(len(one), dtype=bool)
    while len(forest) < TREES or (met.mean() < RECALL and len(forest) < MOST_TREES):
        forest.append(Tree(sample, depth, SEED + len(forest)))
        met |= _meet(forest[-1], one, two)
    return forest


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, dim)
    # Scaled first, so that very large or very small components do not overflow the norm.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vectors(df: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, vector): components as little-endian doubles; null where the vector cannot link."""
    ready(df.sparkSession)

    def run(batches):
        for ids, rows in batches:
            dims, out = [], []
            for row in rows:
                v = np.array([np.nan if x is None else x for x in row or ()], dtype="<f8")
                good = len(v) and np.isfinite(v).all() and v.any()
                dims.append(len(v) if good else None)
                out.append((v + 0.0).tobytes() if good else None)
            yield [ids, dims, out]

    rows = df.select(F.col(key).cast("long").alias("__id"), F.col(embedding).cast("array<double>").alias("__v"))
    return map_rows(rows, run, "vec_id long, dim int, vector binary")


def _assign(forests: dict[int, list[Tree]]):
    def run(batches):
        for reps, counts, dims, raw in batches:
            dims = np.array(dims)
            leaves: list[list[int]] = [[] for _ in reps]
            for dim, forest in forests.items():
                of = np.flatnonzero(dims == dim)
                if not len(of):
                    continue
                rows = _unit([raw[i] for i in of], dim)
                for number, tree in enumerate(forest):
                    for row, leaf in zip(*(a.tolist() for a in tree.leaves(rows))):
                        leaves[of[row]].append((leaf * len(forest) + number) * 4096 + dim % 4096)
            yield [reps, counts, dims, raw, [sorted(set(own)) for own in leaves]]

    return run


def _compare(group: pa.Table) -> pa.Table:
    """Links within a block, or between two blocks of one leaf: per vector their number, and a spanning link."""
    dim, leaf = group["dim"][0].as_py(), group["leaf"][0].as_py()
    one, two = group["one"][0].as_py(), group["two"][0].as_py()
    reps, counts = group["rep"].to_numpy(), group["copies"].to_numpy()
    rows = _unit(group["vector"].to_pylist(), dim)
    close = rows @ rows.T >= THRESHOLD
    if one != two:
        block = group["block"].to_numpy()
        close &= block[:, None] != block[None, :]
    np.fill_diagonal(close, False)
    if close.any():
        touched = np.flatnonzero(close.any(axis=1))
        close, reps, counts = close[np.ix_(touched, touched)], reps[touched], counts[touched]
        lists = group["leaves"].take(pa.array(touched)).to_pylist()
        before: dict[int, int] = {}
        places = [(i, before.setdefault(x, len(before))) for i, own in enumerate(lists) for x in own if x < leaf]
        if places:
            holds = np.zeros((len(touched), len(before)), dtype=np.float32)
            holds[tuple(np.array(places).T)] = 1
            close &= holds @ holds.T == 0
        least = np.arange(len(reps))
        order = np.argsort(reps, kind="stable")
        rank = np.empty(len(reps), dtype=np.int64)
        rank[order] = least
        label = rank.copy()
        while True:
            after = np.minimum(label, np.where(close, label[None, :], len(reps)).min(axis=1))
            if (after == label).all():
                break
            label = after
        links = close @ counts
        found = pa.table({"a": reps, "b": reps[order][label], "links": links.astype(np.int64)})
        return found
    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})


def near_duplicates(df: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    length do not link. Equal vectors are handled as one and link with each other, as do repeated rows. A
    null id gets no component of its own (null). An empty table gives no rows.
    """
    spark = ready(df.sparkSession)
    rows = cut_lineage(vectors(df, key, embedding))
    distinct = cut_lineage(
        rows.filter("dim is not null").groupBy("dim", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("rep", F.xxhash64("vector", "dim"))
    )
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    forests = {}
    for dim, n in sizes.items():
        sample = distinct.filter(F.col("dim") == dim).orderBy("rep").select("vector").limit(SAMPLE_ROWS).collect()
        fitted = _unit([r["vector"] for r in sample], dim)
        forests[dim] = grow(fitted, n)
    assigned = cut_lineage(
        map_rows(distinct.select("rep", "copies", "dim", "vector"), _assign(forests), "rep long, copies long, dim int, vector binary, leaves array<long>")
    )
    placed = assigned.withColumn("leaf", F.explode("leaves"))
    blocks = assigned.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
    # A leaf of several blocks is compared block against block, each pair of blocks a group of its own.
    shared = placed.join(blocks, "leaf").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), "blocks"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    shared = shared.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    compared = shared.groupBy("leaf", "one", "two").applyInArrow(_compare, "a long, b long, links long")
    found = cut_lineage(compared)
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"))
    grouped = groups.join(distinct.select("rep", "least"), groups["node"] == F.col("rep")).select("rep", "component", "least")
    group_least = grouped.groupBy("component").agg(F.min("least").alias("group_least"))
    of_rep = grouped.join(group_least, "component").select("rep", "group_least")
    known = (
        distinct.join(links, "rep", "left").join(of_rep, "rep", "left")
        .select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("group_least", "least").alias("component"))
    )
    # Vectors that cannot link have no key, and no part in the join.
    joined = rows.filter("dim is not null").join(cut_lineage(known), ["dim", "vector"]).select("vec_id", "links", "component")
    alone = rows.filter("dim is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    joined = joined.union(alone)
    return joined.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
