"""Hard negatives by segment summary filtering.

Every vector is cut into segments, and each segment's mean and deviation are stored with it. For two segments of length w,
``w (mean mean' ± dev dev')`` bounds their share of the inner product, so sums over segments bound a score. Scores are
bounded on few long segments first, what is left on shorter ones, and only what is left then is scored exactly.

Anchors meet all rows in cells of one block of rows and one block of anchors. A cell streams its rows past its anchors and
keeps, per anchor, the best found so far: they are what bounds are held against. Cells hand on their best ones, at most
as many as are asked for, and a window picks among those of all cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from creditloom.llm.base import map_rows
from creditloom.session import cut_lineage

# Segments of a vector at the first and the second level.
SEGMENTS = (4, 16)
# Anchors in a block, and rows that a cell looks at together: a matrix of scores stays under 16 MB.
ANCHOR_BLOCK = 1024
CHUNK = 1024
# Blocks of rows: the square root of the rows over this, so that blocks and their number both grow with the table.
ROWS_SCALE = 64
# Pairs left below this share are looked at one by one, else as a block.
SPARSE = 0.02
# Error of summed doubles, as a share of the product of the norms.
SLACK = 1e-10
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def summary(vectors: np.ndarray) -> list[np.ndarray]:
    """Per level, (means, deviations) of the segments of each row, both times the root of the segment's length."""
    found = []
    width = vectors.shape[1]
    for parts in SEGMENTS:
        cuts = np.unique(np.linspace(0, width, min(parts, width) + 1).astype(np.int64))[:-1]
        if not width:
            found += [np.zeros((len(vectors), 0))] * 2
            continue
        size = np.diff(np.append(cuts, width))
        mean = np.add.reduceat(vectors, cuts, axis=1) / size
        spread = vectors - np.repeat(mean, size, axis=1)
        found += [mean * np.sqrt(size), np.sqrt(np.add.reduceat(spread * spread, cuts, axis=1))]
    return found


def store(rows: DataFrame, key: str, label: str, vector: str, anchors: Column) -> DataFrame:
    """(row, id, label, dim, vector, summary, anchor), written: vectors as doubles, summaries of both levels.

    Rows with a null label, a null vector, or a null or non-finite component take no part.
    """
    whole = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = rows.filter(F.col(label).isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vector"),
    )

    def summed(batches):
        for row, ids, labels, anchor, vectors in batches:
            dims, raw, parts = [len(v) for v in vectors], [], []
            for _, same in groupby(vectors, len):
                block = np.array(list(same), dtype=np.float64)
                raw += [v.tobytes() for v in block]
                parts += [p.tobytes() for p in np.concatenate(summary(block), axis=1)]
            yield [row, ids, labels, anchor, dims, raw, parts]

    return cut_lineage(
        map_rows(known, summed, "row long, id long, label long, anchor boolean, dim int, vector binary, summary binary")
    )


def _array(cells: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(cells), dtype=np.float64)
    return flat.reshape(len(cells), -1) if cells else flat.reshape(0, 0)


class Vectors:
    """Vectors of one length with their summaries."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[bytes], summaries: list[bytes]):
        self.ids, self.labels = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64)
        self.vectors = _array(vectors)
        width = self.vectors.shape[1]
        sizes = np.repeat([min(n, width) for n in SEGMENTS], 2)
        self.levels = np.split(_array(summaries), np.cumsum(sizes)[:-1], axis=1)
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.largest = np.abs(self.vectors).max(initial=0.0)


def exact(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray, pairs: bool) -> np.ndarray:
    """Inner products of integer vectors, as numbers that hold them exactly; beyond a long they are its limits."""
    left, right = a.vectors[i], b.vectors[j]
    if a.largest * b.largest * max(left.shape[1], 1) >= 2.0**53:
        left, right = left.astype(np.longdouble), right.astype(np.longdouble)
        made = (left * right).sum(axis=1) if pairs else left @ right.T
        return np.clip(made, np.longdouble(_LEAST), np.longdouble(_MOST))
    return np.einsum("ij,ij->i", left, right) if pairs else left @ right.T


def scored(a: Vectors, b: Vectors, allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the allowed pairs with ``low[i] <= score <= high[i]``, by bounds first."""
    left, i, j = allowed, np.arange(len(a.ids)), np.arange(len(b.ids))
    for level in (0, 2):
        rows, columns = left.any(axis=1), left.any(axis=0)
        if not rows.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        i, j, left = i[rows], j[columns], left[rows][:, columns]
        if left.mean() < SPARSE:
            break
        middle = a.levels[level][i] @ b.levels[level][j].T
        spread = a.levels[level + 1][i] @ b.levels[level + 1][j].T + SLACK * np.outer(a.norm[i], b.norm[j])
        left = left & (middle + spread >= low[i, None]) & (middle - spread <= high[i, None])
    if left.mean() >= SPARSE:
        score = exact(a, i, b, j, False)
        left = left & (score >= low[i, None]) & (score <= high[i, None])
        x, y = np.nonzero(left)
        return i[x], j[y], score[x, y]
    x, y = np.nonzero(left)
    i, j = i[x], j[y]
    for level in (0, 2):
        middle = np.einsum("ij,ij->i", a.levels[level][i], b.levels[level][j])
        spread = np.einsum("ij,ij->i", a.levels[level + 1][i], b.levels[level + 1][j]) + SLACK * a.norm[i] * b.norm[j]
        left = (middle + spread >= low[i]) & (middle - spread <= high[i])
        i, j = i[left], j[left]
    score = exact(a, i, b, j, True)
    left = (score >= low[i]) & (score <= high[i])
    return i[left], j[left], score[left]


class Best:
    """Per query the first ``most`` of the (score, id) seen: higher scores first, ties by smaller id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.query, self.ids, self.score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, ids = np.concatenate([self.query, query]), np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first
        keep = rank < self.most
        self.query, self.ids, self.score = query[keep], ids[keep], score[keep]
        last = rank == self.most - 1
        self.least[query[last]] = score[last].astype(np.float64)


def _below(x: np.ndarray) -> np.ndarray:
    """Scores that became doubles may have been rounded up: one step down never loses a tie."""
    return np.where(np.abs(x) < 2.0**53, x, np.nextafter(x, -np.inf))


class Positives:
    """The best rows of the anchors' own labels."""

    def __init__(self, rows: list[int], anchors: Vectors, windows: list, most: int):
        self.rows, self.anchors, self.best = rows, anchors, Best(len(rows), most)

    def look(self, chunk: Vectors) -> None:
        a, free = self.anchors, np.full(len(self.rows), np.inf)
        for label in np.unique(chunk.labels):
            mine, own = np.flatnonzero(a.labels == label), np.flatnonzero(chunk.labels == label)
            if len(mine):
                allowed = np.zeros((len(a.ids), len(chunk.ids)), dtype=bool)
                allowed[np.ix_(mine, own)] = a.ids[mine, None] != chunk.ids[own]
                i, j, score = scored(a, chunk, allowed, _below(self.best.least), free)
                self.best.add(i, chunk.ids[j], score)

    def found(self) -> list:
        b = self.best
        return [[self.rows[q] for q in b.query], [0] * len(b.query), b.ids.tolist(), [int(s) for s in b.score]]


class Negatives:
    """The best rows of other labels within each window of an anchor. Windows are (low, high) of each positive."""

    def __init__(self, rows: list[int], anchors: Vectors, windows: list, most: int):
        self.rows, self.anchors = rows, anchors
        self.queries = [(i, number, *window) for i, own in enumerate(windows) for number, window in enumerate(own)]
        wide = np.longdouble if anchors.largest >= 2.0**20 else np.float64
        self.anchor = np.array([q[0] for q in self.queries], dtype=np.int64)
        self.low = np.array([q[2] for q in self.queries], dtype=wide)
        self.high = np.array([q[3] for q in self.queries], dtype=wide)
        self.best = Best(len(self.queries), most)
        # The queries of an anchor stand together.
        self.first = np.searchsorted(self.anchor, np.arange(len(rows)), side="left")
        self.last = np.searchsorted(self.anchor, np.arange(len(rows)), side="right")

    def look(self, chunk: Vectors) -> None:
        a, n = self.anchors, len(self.rows)
        # A row matters to an anchor if it does to one of its queries.
        open_from = np.maximum(self.low.astype(np.float64), self.best.least)
        usable = self.low <= self.high
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, self.anchor[usable], _below(open_from[usable]))
        np.maximum.at(high, self.anchor[usable], np.nextafter(self.high[usable].astype(np.float64), np.inf))
        allowed = (a.labels[:, None] != chunk.labels) & (low <= high)[:, None]
        i, j, score = scored(a, chunk, allowed, low, high)
        # Each pair under every query of its anchor.
        copies = (self.last - self.first)[i]
        pair = np.repeat(np.arange(len(i)), copies)
        query = self.first[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(copies) - copies, copies)
        value = score[pair]
        keep = (value >= self.low[query]) & (value <= self.high[query]) & (value >= _below(self.best.least[query]))
        self.best.add(query[keep], chunk.ids[j[pair[keep]]], value[keep])

    def found(self) -> list:
        b = self.best
        anchor = [self.rows[self.queries[q][0]] for q in b.query]
        return [anchor, [self.queries[q][1] for q in b.query], b.ids.tolist(), [int(s) for s in b.score]]


def _stream(look: type, most: int):
    """Rows of cells in order (anchors first, then rows by length): the best of each cell."""

    def run(batches: Iterator[list]) -> Iterator[list]:
        cell, held, waiting = None, {}, None

        def ask():
            """The anchors gathered for the cell, by length."""
            return {
                dim: look(of["row"], Vectors(of["id"], of["label"], of["vector"], of["summary"]), of["windows"], most)
                for dim, of in held.items()
            }

        def flush():
            nonlocal waiting
            if waiting and waiting["dim"] in askers:
                askers[waiting["dim"]].look(Vectors(waiting["id"], waiting["label"], waiting["vector"], waiting["summary"]))
            waiting = None

        askers: dict[int, object] = {}
        asked = False
        for rb, ab, kind, dim, label, row, ids, vector, parts, windows in batches:
            for at in range(len(rb)):
                if (rb[at], ab[at]) != cell:
                    flush()
                    for asker in askers.values():
                        yield asker.found()
                    cell, held, askers, asked = (rb[at], ab[at]), {}, {}, False
                if kind[at] == 0:
                    of = held.setdefault(dim[at], {k: [] for k in ("row", "id", "label", "vector", "summary", "windows")})
                    of["row"].append(row[at])
                    of["windows"].append([(w["low"], w["high"]) for w in windows[at] or []])
                else:
                    if not asked:
                        askers, asked = ask(), True
                    if waiting and (waiting["dim"] != dim[at] or len(waiting["id"]) >= CHUNK):
                        flush()
                    waiting = waiting or {"dim": dim[at], "id": [], "label": [], "vector": [], "summary": []}
                    of = waiting
                of["id"].append(ids[at])
                of["label"].append(label[at])
                of["vector"].append(vector[at])
                of["summary"].append(parts[at])
        flush()
        for asker in askers.values():
            yield asker.found()

    return run


def _best(stored: DataFrame, anchors: DataFrame, sizes: tuple[int, int], look: type, most: int) -> DataFrame:
    """(anchor, number, id, score, rank): the first ``most`` of each query over all cells."""
    blocks, anchor_blocks = sizes
    columns = ("rb", "ab", "kind", "dim", "label", "row", "id", "vector", "summary", "windows")
    block = F.xxhash64("row")
    asking = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), F.pmod(block, F.lit(anchor_blocks)).cast("int").alias("ab"),
        F.lit(0).alias("kind"), *columns[3:],
    )
    asked = stored.withColumn("windows", F.lit(None).cast(anchors.schema["windows"].dataType)).select(
        F.pmod(block, F.lit(blocks)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))).alias("ab"),
        F.lit(1).alias("kind"), *columns[3:],
    )
    cells = asking.unionByName(asked).repartition(min(2 * blocks * anchor_blocks, 20_000), "rb", "ab")
    cells = cells.sortWithinPartitions("rb", "ab", "kind", "dim", "label")
    found = map_rows(cells, _stream(look, most), "anchor long, number int, id long, score long")
    order = Window.partitionBy("anchor", "number").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    n_positives: int = 5,
    n_negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over integer-valued vectors.

    A score is the exact inner product with the anchor; higher scores come first, ties by smaller id. An anchor's positives
    are its first ``n_positives`` rows with its label and another id; for each of them come the first ``n_negatives`` rows of other
    labels with ``low_percent * positive <= 100 * negative <= high_percent * positive``.

    Rows without a label or with a null or non-finite component take no part; vectors are only held against vectors of their
    length; empty ones score 0. Repeated rows take part as often as they occur, as anchors and as candidates. A null id is no anchor and never
    a positive or negative. Scores beyond a long are its limits. An empty table gives no rows, other columns may have any name. The work is
    anchors times rows at worst: a row travels once per block of anchors, an anchor once per block of rows.
    """
    stored = store(rows.filter(F.col(key).isNotNull()), key, label, vector, anchors)
    n, n_anchors = stored.agg(F.count("*"), F.count_if("anchor")).first()
    sizes = max(math.ceil(math.sqrt(n / ROWS_SCALE)), 1), max(math.ceil(n_anchors / ANCHOR_BLOCK), 1)
    asking = stored.filter("anchor")
    none = F.lit(None).cast("array<struct<low: long, high: long>>")
    positives = cut_lineage(_best(stored, asking.withColumn("windows", none), sizes, Positives, n_positives))
    # Whole numbers: low rounds up, high rounds down. Decimals, as a percentage of a long may exceed one.
    score = F.col("score").cast("decimal(25,0)")
    low = F.ceil(score * low_percent / 100).cast("long").alias("low")
    high = F.floor(score * high_percent / 100).cast("long").alias("high")
    windows = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low, high))).alias("w"))
    windows = windows.select(F.col("anchor").alias("row"), F.transform("w", lambda w: F.struct(w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    found = _best(stored, asking.join(windows, "row"), sizes, Negatives, n_negatives)
    pairs = found.select("anchor", (F.col("number") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return pairs.join(of, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def quantised(vector: str = "embedding") -> Column:
    """Each component times 256, rounded down, as a double."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.when(
        F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(_floor(x * 256.0)))


def _floor(x: Column) -> Column:
    """Floor as a double: beyond 2^52 every double is whole, and a long would not hold it."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
