import numpy as np

from creditloom.llm import forest


def brute(rows):
    good = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, dtype=float)
            a = a / np.abs(a).max()
            good[n] = a / np.linalg.norm(a)
    links = {n: [m for m in good if m != n and len(good[m]) == len(good[n]) and good[n] @ good[m] >= 0.9] if n in good else [] for n in range(len(rows))}
    least = {n: rows[n][0] for n in links}
    while True:
        after = {n: min([least[n], *(least[m] for m in own)]) for n, own in links.items()}
        if after == least:
            return links, least
        least = after


def test_small_tables_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype("f4")]) for i in range(60)]
    rows += [(100 + i, [float(x) for x in np.float32(np.array(rows[i][1]) * (2 + i) + rng.standard_normal(8) * 0.1)]) for i in range(30)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, []), (204, [0.0] * 8), (205, [None, *rows[3][1][1:]]), (206, [float("nan")] * 8),
             (207, [float("inf")] * 8), (208, [1.0, 2.0]), (209, [2.0, 4.0]), (5, rows[5][1]), (210, [1e38] * 8), (211, [1e-38] * 8)]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, dim int")
    found = sorted(tuple(r) for r in forest.near_duplicates(frame).collect())
    links, least = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    want = sorted((rows[n][0], len(links[n]), least[n], rows[n][0] == least[n]) for n in links)
    assert found == want
    assert forest.near_duplicates(frame.limit(0)).collect() == []


def test_large_leaves_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 9)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in np.float32(centre + rng.standard_normal(16) * 0.3)]) for i in range(70)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    links, least = brute([(r.vec_id, r.embedding) for r in frame.collect()])
    found = sorted(tuple(r) for r in forest.near_duplicates(frame).collect())
    assert found == sorted((n, len(links[n]), least[n], n == least[n]) for n in links)


def test_recall_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF_ROWS", 32)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum()) - len(ids)
    found = forest.near_duplicates(table).collect()
    assert 0.95 * want <= sum(r.n_links for r in found) <= want


def test_pairs_at_the_threshold_meet_below_the_fitted_levels():
    rng = np.random.default_rng(3)
    draw = lambda n: (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    # 512 rows fit five levels; a million rows make twelve.
    trees = forest.grow(draw(512), 1_000_000)
    assert len(trees[0].directions) == 12 and max(trees[0].cuts) < 2**6
    one, away = draw(1500), draw(1500)
    away -= (away * one).sum(axis=1, keepdims=True) * one
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9, 0.91, (1500, 1))
    two = cosine * one + np.sqrt(1 - cosine**2) * away
    met = np.zeros(1500, dtype=bool)
    for tree in trees:
        held = [set() for _ in range(3000)]
        for row, leaf in zip(*tree.leaves(np.vstack((one, two)))):
            held[row].add(leaf)
        met |= np.array([bool(held[i] & held[1500 + i]) for i in range(1500)])
    assert met.mean() >= 0.95
    # More rows, deeper trees: their number follows.
    assert len(forest.grow(draw(512), 2**28)) > len(trees)
