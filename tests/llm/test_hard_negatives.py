import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string"
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _plain(rows, is_anchor, n_positives=5, n_negatives=10):
    """Brute force over lists in whole numbers."""
    usable = [
        (i, [int(x) for x in v], label)
        for i, v, label, _ in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, v, label in usable:
        if not is_anchor(i):
            continue
        scores = [
            (-max(min(sum(x * y for x, y in zip(v, w)), MOST), LEAST), j, other)
            for j, w, other in usable
            if len(w) == len(v)
        ]
        for p, j, _ in sorted(s for s in scores if s[2] == label and s[1] != i)[:n_positives]:
            near = sorted(s for s in scores if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)[:n_negatives]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(near, 1)]
    return sorted(out)


def _mined(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, hard_negatives.mine(docs, F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize("width, top", [(64, 90), (7, 3), (1, 2)])
def test_equals_brute_force(spark, monkeypatch, width, top):
    monkeypatch.setattr(hard_negatives, "CHUNK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 9)
    monkeypatch.setattr(hard_negatives, "ROWS_SCALE", 16)
    rng = random.Random(width)
    middle = [[rng.randint(-top, top) for _ in range(width)] for _ in range(6)]
    rows = [
        (i, [float(x + rng.randint(-top // 2, top // 2)) for x in middle[rng.randrange(6)]], rng.choice([0, 0, 0, 1, 2]), "x")
        for i in range(300)
    ]
    expected = _plain(rows, lambda i: i % 10 == 0)
    assert expected and _mined(spark, rows) == expected


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (10, [3.0, 4.0, 1.0], 1, None), (10, [3.0, 4.0, 1.0], 1, None), (11, [3.0, 4.0, 2.0], 1, "a"), (11, [3.0, 4.0, 2.0], 1, "b"),
        (12, [2.0, 2.0, 0.0], 2, None), (13, [2.0, 2.0, 0.0], 2, None), (14, [1.0, 2.0, 3.0], 3, None), (20, [0.0, 0.0, 0.0], 2, None),
        (15, None, 1, None), (16, [1.0, 2.0, None], 1, None), (17, [1.0, nan, 2.0], 2, None), (18, [inf, 1.0, 1.0], 2, None),
        (19, [3.0, 4.0, 2.0], None, None), (None, [3.0, 4.0, 2.0], 1, None), (30, [1.0, 1.0], 1, None), (31, [2.0, 1.0], 1, None),
        (32, [1.0, 1.0], 2, None), (40, [], 1, None), (41, [], 1, None), (42, [], 2, None), (50, [9.0] * 5000, 1, None), (51, [8.0] * 5000, 1, None),
        (52, [6.0] * 5000, 2, None),
        # Beyond doubles, and beyond a long.
        (60, [2.0**40, 3.0, 0.0, 1.0], 1, None), (61, [2.0**21, 2.0**30 + 1, 1.0, 1.0], 1, None), (62, [2.0**20, 7.0, 1.0, 1.0], 2, None),
        (63, [2.0**20, 7.0, 1.0, 2.0], 2, None), (70, [2.0**60, 1.0, 1.0, 1.0, 1.0], 1, None), (71, [2.0**60, 2.0, 1.0, 1.0, 1.0], 1, None),
        (72, [4.0, 2.0, 1.0, 1.0, 1.0], 2, None),
    ]
    expected = _plain(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in expected} >= {10, 30, 50, 60}
    assert _mined(spark, rows) == expected
    assert _mined(spark, rows, n_positives=1, n_negatives=1) == _plain(rows, lambda i: i % 10 == 0, 1, 1)
    assert _mined(spark, []) == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 23)).round(2) * 100, rng.normal(size=(50, 23)).round(2) * 100
    left, right = hard_negatives.summary(a), hard_negatives.summary(b)
    width = []
    for level in (0, 2):
        middle, spread = left[level] @ right[level].T, left[level + 1] @ right[level + 1].T + 1e-6
        assert (np.abs(a @ b.T - middle) <= spread).all()
        width.append(spread.mean())
    assert width[1] < width[0]


def test_query_equals_sql(spark):
    import duckdb

    from creditloom.llm.queries import ORACLES, QUERIES

    folder = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = QUERIES["op13_segments"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(ORACLES["op13_segments"]).fetchall())
