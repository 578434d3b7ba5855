"""Benchmark leaks by greedy string tiling.

Shared runs of ``RUN`` words seed (document, item) pairs; per pair, the longest match of words not yet marked is
marked again and again, found by Karp-Rabin hashes of runs, so passages count even if their parts were moved.
An item leaks into a document if the tiles cover ``COVERAGE`` of its words.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import map_rows, texts

RUN = 5
COVERAGE = 0.8
# Words of benchmark text that one scan of the documents is matched with; a larger benchmark takes more scans.
BLOCK_WORDS = 500_000
# Pairs of places of an item and a document that are compared at a time.
PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\w+")

LEAK_SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, n_words int"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


def run_hashes(ids: np.ndarray, run: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``run`` word numbers."""
    n = len(ids) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(run):
        hashes = hashes * _BASE + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    return hashes


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges [low, high), and for each the range that it is from."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[of], of


def _whole_matches(item: np.ndarray, doc: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
    """Matches that go on as far as they can on both sides, as rows (place in item, place in doc, words).

    Pairs of places are made in blocks of about ``PAIRS``, and of a match only its first pair is kept. Matches of the same
    words of the item differ only in their place in the document. A tile spoils less than twice the item's length of such
    places, so of more than all tiles can spoil, the later ones are never chosen and need not be held.
    """
    hashes = run_hashes(item, run)
    order = np.argsort(hashes, kind="stable")
    hashes, own = hashes[order], run_hashes(doc, run)[starts]
    low, high = np.searchsorted(hashes, own, side="left"), np.searchsorted(hashes, own, side="right")
    enough = len(item) // run * 2 * len(item) + 1
    found = np.zeros((0, 3), dtype=np.int64)
    block = (np.cumsum(high - low) - 1) // PAIRS
    for number in np.unique(block):
        inside = slice(*np.searchsorted(block, [number, number + 1]))
        at, of = _spread(low[inside], high[inside])
        i, d = order[at], starts[inside][of]
        inner = (i > 0) & (d > 0)
        inner &= item[i - 1] == doc[d - 1]
        i, d = i[~inner], d[~inner]
        same = np.ones(len(i), dtype=bool)
        for k in range(run):
            same &= item[i + k] == doc[d + k]
        i, d = i[same], d[same]
        n = np.full(len(i), run)
        growing = np.flatnonzero((i + run < len(item)) & (d + run < len(doc)))
        while len(growing):
            growing = growing[item[i[growing] + n[growing]] == doc[d[growing] + n[growing]]]
            n[growing] += 1
            growing = growing[(i[growing] + n[growing] < len(item)) & (d[growing] + n[growing] < len(doc))]
        found = np.concatenate([found, np.column_stack([i, d, n])])
        if len(found) > enough:
            found = found[np.lexsort((found[:, 1], found[:, 2], found[:, 0]))]
            new = np.ones(len(found), dtype=bool)
            new[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 2] != found[:-1, 2])
            first = np.flatnonzero(new)
            found = found[np.arange(len(found)) - first[np.cumsum(new) - 1] < enough]
    return found


def _cut(matches: np.ndarray, axis: int, low: int, high: int, run: int) -> np.ndarray:
    """What is left of matches outside the places [low, high) of item (axis 0) or document (axis 1)."""
    at, n = matches[:, axis], matches[:, 2]
    met = (at < high) & (at + n > low)
    if not met.any():
        return matches
    hit = matches[met]
    before, after = hit.copy(), hit.copy()
    before[:, 2] = low - hit[:, axis]
    gone = high - hit[:, axis]
    after[:, 0] += gone
    after[:, 1] += gone
    after[:, 2] -= gone
    return np.concatenate([matches[~met], before[before[:, 2] >= run], after[after[:, 2] >= run]])


def tiles(item: np.ndarray, doc: np.ndarray, starts: np.ndarray, run: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of greedy tiles; ``starts`` are the places in doc where a run may match, ascending.

    Of the longest matches the first in the item, then in the document, is marked.
    """
    found = []
    matches = _whole_matches(item, doc, starts, run)
    while len(matches):
        longest = matches[matches[:, 2] == matches[:, 2].max()]
        i, d, n = longest[np.lexsort((longest[:, 1], longest[:, 0]))[0]].tolist()
        found.append((i, d, n))
        matches = _cut(_cut(matches, 0, i, i + n, run), 1, d, d + n, run)
    return found


def _index(items: list[tuple[int, list[str]]]):
    """Word numbers of the block, its items, and per run length the sorted hashes of their runs with item numbers."""
    vocabulary: dict[str, int] = {}
    coded = [
        (item_id, np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64))
        for item_id, words in items
    ]
    by_run = {}
    for number, (_, ids) in enumerate(coded):
        run = min(RUN, len(ids))
        by_run.setdefault(run, []).append((np.unique(run_hashes(ids, run)), number))
    sorted_runs = {}
    for run, parts in by_run.items():
        hashes = np.concatenate([h for h, _ in parts])
        owner = np.concatenate([np.full(len(h), n) for h, n in parts])
        order = np.argsort(hashes, kind="stable")
        sorted_runs[run] = hashes[order], owner[order]
    return vocabulary, coded, sorted_runs


def _scan(index, coverage: float):
    vocabulary, coded, sorted_runs = index

    def run_batches(batches):
        get = vocabulary.get
        for ids, bodies in batches:
            out = [[] for _ in range(5)]
            for doc_id, body in zip(ids, bodies):
                doc = [get(w, -1) for w in words_of(body)]
                numbers = np.array(doc, dtype=np.int64)
                unknown = np.concatenate(([0], np.cumsum(numbers < 0)))
                for run, (hashes, owner) in sorted_runs.items():
                    if len(doc) < run:
                        continue
                    whole = np.flatnonzero(unknown[run:] == unknown[:-run])
                    if not len(whole):
                        continue
                    own = run_hashes(numbers, run)[whole]
                    low = np.searchsorted(hashes, own, side="left")
                    hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own))
                    at, of = _spread(low[hit], np.searchsorted(hashes, own[hit], side="right"))
                    owners, places = owner[at], whole[hit][of]
                    order = np.argsort(owners, kind="stable")
                    owners, places = owners[order], places[order]
                    ends = np.append(np.flatnonzero(np.diff(owners)) + 1, len(owners)) if len(owners) else []
                    first = 0
                    for end in ends:
                        number, starts, first = owners[first], places[first:end], end
                        item_id, item = coded[number]
                        # So many runs cover no more words than this; most chance hits end here.
                        if len(starts) * run < coverage * len(item):
                            continue
                        found = tiles(item, numbers, starts, run)
                        covered = sum(n for _, _, n in found)
                        if covered and covered >= coverage * len(item) - 1e-9:
                            for column, value in zip(out, (doc_id, item_id, covered / len(item), len(found), len(item))):
                                column.append(value)
            yield out

    return run_batches


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per (document, item) whose tiles cover the item: doc_id, item_id, coverage, n_tiles, n_words.

    Items shorter than ``RUN`` words must match in one run; items without words (null, empty) never match.
    Repeated items and repeated documents give a row each. Documents are only scanned, never shuffled. The
    benchmark travels in blocks of at most ``BLOCK_WORDS`` words (one longer item is a block of its own), one scan each.
    """
    rows = texts(docs)
    result, block, size = None, [], 0

    def scan(items):
        return map_rows(rows, _scan(_index(items), coverage), LEAK_SCHEMA)

    for row in texts(benchmark, "item_id").orderBy("__id", "__text").toLocalIterator():
        words = words_of(row["__text"])
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            made = scan(block)
            result, block, size = made if result is None else result.union(made), [], 0
        block.append((row["__id"], words))
        size += len(words)
    if block:
        made = scan(block)
        result = made if result is None else result.union(made)
    return rows.sparkSession.createDataFrame([], LEAK_SCHEMA) if result is None else result


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a leak, in their own columns. Documents without an id cannot be named and stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__leaky")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__leaky"), "left_anti")
