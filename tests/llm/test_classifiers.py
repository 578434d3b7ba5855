import random

import numpy as np
import pytest

from creditloom.llm import quality, toxicity
from creditloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def held_out(spark, rows, label, folder=SMALL):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    return [(r, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]


def auc(pairs):
    ones, zeros = [r.score for r, y in pairs if y], [r.score for r, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def test_toxicity_held_out(spark):
    rows = QUERIES["op3_toxicity"](spark, SMALL).collect()
    pairs = held_out(spark, rows, "toxic")
    assert auc(pairs) > 0.93
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_held_out(spark):
    rows = QUERIES["op5_quality"](spark, SMALL).collect()
    pairs = held_out(spark, rows, "quality")
    assert auc(pairs) > 0.95
    assert np.mean([r.predicted == y for r, y in pairs]) > 0.93
    assert len(rows) == 1000 and all(r.predicted == (r.score >= 0.3) for r in rows)


@pytest.fixture
def biased(spark):
    """Insults are toxic; in the sample a group is named more often in toxic texts than in others."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(600):
        toxic = i % 2
        text = [rng.choice(words) for _ in range(8)]
        text += [rng.choice(["idiot", "moron"])] * (toxic and rng.random() < 0.8)
        text += [rng.choice(["muslim", "muslims"])] * (rng.random() < (0.6 if toxic else 0.05))
        rng.shuffle(text)
        rows.append((i, " ".join(text), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_neutral_mentions_keep_their_score(spark, biased, monkeypatch):
    docs, labels = biased.select("doc_id", "text"), biased.select("doc_id", "toxic")

    def change():
        model = toxicity.train(docs, labels)
        return abs(model.score("word1 muslim word2") - model.score("word1 christian word2")), model

    regularised, model = change()
    monkeypatch.setattr(toxicity, "SWAP_PENALTY", 0.0)
    plain, _ = change()
    assert regularised < 0.1 < plain
    assert model.score("word1 idiot word2") > 0.5 > model.score("word1 muslim word2")


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, module, label):
    docs = [(1, None, 0.1), (2, "", 0.1), (None, "no id", None), (3, "x " * 90_000, 0.1), (4, "word", 0.1), (4, "word", 0.1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (4, 1), (None, 1)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        rows = module.classify(frame, known).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(d[0]) for d in docs)
        assert all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert module.classify(frame.limit(0), labels).collect() == []


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    used = {r["__id"] for r in toxicity.labelled_rows(docs, labels, "toxic", 1000).collect()}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}
    few = {r["__id"] for r in toxicity.labelled_rows(docs, labels, "toxic", 7).collect()}
    assert len(few) == 7 and few < used


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.standard_normal((n, quality.TRAITS)) for n in (1, 3, 2)]
    rows, bag, labels = np.vstack(bags), np.repeat([0, 1, 2], [1, 3, 2]), np.array([1.0, 0.0, 1.0])
    model, weight = quality.Model.start(rows), np.ones(3) / 3
    grads = model.gradients(rows, bag, labels, weight)

    def loss():
        y = model.forward(rows, bag, 3)[-1]
        return -(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))).sum()

    for name in ("W", "V", "U", "w", "c", "d", "b"):
        part = model.parts[name]
        at = tuple(rng.integers(0, n) for n in part.shape)
        kept, step = part[at], 1e-6
        part[at] = kept + step
        up = loss()
        part[at] = kept - step
        down = loss()
        part[at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5, name


def test_endings_of_all_words_count():
    import zlib

    words = [f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(64)]
    want = np.bincount([zlib.crc32(w[-2:].encode()) % quality.ENDINGS for w in words], minlength=quality.ENDINGS) / 64
    assert np.allclose(quality.passages(" ".join(words))[0, 22:], want)
