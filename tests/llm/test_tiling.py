import random
import time

import numpy as np
import pytest
from creditloom.llm import tiling


def brute_tiles(item, doc, run):
    """Longest common unmarked run, again and again, by comparing all places."""
    item_free, doc_free, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and item_free[i + n] and doc_free[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < run:
            return total
        item_free[i : i + n] = doc_free[d : d + n] = [False] * n
        total += n


@pytest.mark.parametrize("pairs", [tiling.PAIRS, 7])
def test_tiles_match_the_plain_search(monkeypatch, pairs):
    monkeypatch.setattr(tiling, "PAIRS", pairs)
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randint(0, 6) for _ in range(rng.randint(5, 24))]
        doc = [rng.randint(0, 6) for _ in range(20)] + item[8:] + [9] + item[:8] + [rng.randint(0, 6) for _ in range(9)]
        starts = np.arange(len(doc) - 2)
        found = tiling.tiles(np.array(item), np.array(doc), starts, 3)
        assert sum(n for _, _, n in found) == brute_tiles(item, doc, 3)


@pytest.mark.parametrize("letters", [1, 2])
def test_repeated_words_match_the_plain_search(monkeypatch, letters):
    monkeypatch.setattr(tiling, "PAIRS", 50)
    rng = random.Random(letters)
    for _ in range(20):
        item = [rng.randint(1, letters) for _ in range(rng.randint(3, 9))]
        doc = [rng.randint(0, letters) for _ in range(90)]
        found = tiling.tiles(np.array(item), np.array(doc), np.arange(len(doc) - 2), 3)
        assert sum(n for _, _, n in found) == brute_tiles(item, doc, 3)
        spots = [p for _, d, n in found for p in range(d, d + n)]
        assert len(spots) == len(set(spots)) and all(item[i : i + n] == doc[d : d + n] for i, d, n in found)


def test_one_word_repeated_in_item_and_document():
    item, doc = np.zeros(60, dtype=np.int64), np.zeros(1_000_000, dtype=np.int64)
    began = time.process_time()
    assert tiling.tiles(item, doc, np.arange(len(doc) - 4), 5) == [(0, 0, 60)]
    assert time.process_time() - began < 15


def test_moved_altered_and_clean_documents(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    item = [word() for _ in range(40)]
    filler = lambda n: " ".join(word() for _ in range(n))
    moved = " ".join([filler(9), *item[20:], filler(5), *item[:20], filler(7)])
    altered = item[:]
    altered[12], altered[30] = "zz", "qq"
    docs = [
        (1, f"{filler(30)} {' '.join(item).upper()}! {filler(20)}"), (2, moved), (3, " ".join(altered)), (4, filler(200)),
        (5, " ".join(item[:25])), (6, None), (7, ""), (8, "tiny item here"), (9, " ".join(item)), (9, " ".join(item)),
        (10, filler(40_000) + " " + " ".join(item)),
    ]
    bench = [(100, " ".join(item)), (101, "Tiny item, here."), (102, None), (103, ""), (104, "!!")]
    found = tiling.leaks(
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int"),
        spark.createDataFrame([(i, t, 0) for i, t in bench], "item_id long, text string, doc_id int"),
    )
    got = sorted((r.doc_id, r.item_id) for r in found.collect())
    assert got == [(1, 100), (2, 100), (3, 100), (8, 101), (9, 100), (9, 100), (10, 100)]


def test_blocks_of_the_benchmark_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"p q r s t{i} u v w x") for i in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"q r s t{i} u v w") for i in range(6)], "item_id long, text string")
    want = sorted((i, i) for i in range(6))
    assert sorted((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()) == want
    monkeypatch.setattr(tiling, "BLOCK_WORDS", 10)
    assert sorted((r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()) == want
    assert tiling.leaks(docs.limit(0), bench).collect() == [] and tiling.leaks(docs, bench.limit(0)).collect() == []
    assert tiling.clean(docs, bench).count() == 0 and tiling.clean(docs, bench.limit(0)).count() == 6
