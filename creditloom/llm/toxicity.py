"""Toxicity by a counterfactual-regularised classifier.

Features are the words of a text and the beginnings of its words. The ones that best tell the labels apart are
chosen by their counts over the labelled sample; a logistic model is fitted on them. In every sentence of the sample that names a
group, the name is swapped for others of its set, and the change of the score is penalised, so a neutral mention does not raise it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import crc_mod, map_rows, ready, texts
from creditloom.session import cut_lineage

FOLDS = 5
# Features kept (beside the identity terms), rows a feature needs, lengths of word beginnings.
FEATURES = 4096
MIN_ROWS = 3
# Log-likelihood gain a feature needs: among many thousand features, chance alone rarely gets there.
MIN_GAIN = 9.0
PREFIXES = (3, 4, 5)
# Features are chosen and the model is fitted on at most this many labelled rows.
FIT_ROWS = 20_000
# Weight of squared score changes between a sentence and its swapped versions, and of squared weights.
SWAP_PENALTY = 5.0
DECAY = 2e-5
STEPS = 400
# Words whose features a Python worker remembers.
HELD_WORDS = 400_000

# Names of groups, each set one kind; a name is swapped for the others of its set.
IDENTITY_SETS = (
    ("men", "women", "males", "females", "boys", "girls"),
    ("man", "woman", "male", "female", "boy", "girl", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("american", "mexican", "chinese", "indian", "russian", "german", "french", "spanish", "turkish", "polish"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens", "natives"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
)
_OTHERS = {name: [x for x in names if x != name] for names in IDENTITY_SETS for name in names}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def text_features(text: str) -> set[str]:
    found: set[str] = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(features_of(word))
    return found


def swaps(text: str) -> dict[tuple[tuple[str, ...], tuple[str, ...]], int]:
    """Features that a swap takes from a sentence and those that it brings, with how often they are swapped so.

    Each identity term gives way to every other of its set, and to a stand-in without features: equal terms could all be raised together,
    while a mention that may not change a score against none at all must weigh nothing.
    """
    changed: dict = {}
    for sentence in _SENTENCE.findall(text.lower()):
        words = set(_WORD.findall(sentence))
        for name in words & _OTHERS.keys():
            rest = set().union(*(features_of(w) for w in words - {name}))
            for other in (*_OTHERS[name], None):
                gone, come = set(features_of(name)) - rest, set(features_of(other) if other else ()) - rest
                if gone != come:
                    pair = tuple(sorted(gone - come)), tuple(sorted(come - gone))
                    changed[pair] = changed.get(pair, 0) + 1
    return changed


def _count(batches):
    counts: dict[str, list[int]] = {}
    for labels, bodies in batches:
        for label, body in zip(labels, bodies):
            for name in text_features(body):
                counts.setdefault(name, [0, 0])[label] += 1
        if len(counts) > 500_000:
            yield [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]
            counts.clear()
    if counts:
        yield [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]


def choose(labelled: DataFrame, sizes: tuple[int, int]) -> list[str]:
    """The features whose rows differ most between the labels, by the likelihood ratio; identity terms always."""
    counts = map_rows(labelled.select("label", "__text"), _count, "name string, zeros long, ones long")
    both = counts.groupBy("name").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    n0, n1 = (max(n, 1) for n in sizes)
    n = n0 + n1

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    rows = F.col("zeros") + F.col("ones")
    gain = sum(
        (part(x, r * c / n) for r, cells in ((rows, (F.col("zeros"), F.col("ones"))), (F.lit(n) - rows, (F.lit(n0) - F.col("zeros"), F.lit(n1) - F.col("ones")))) for x, c in zip(cells, (n0, n1))),
        F.lit(0.0),
    )
    best = both.filter(rows >= MIN_ROWS).select("name", F.round(gain, 6).alias("gain")).filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "name").limit(FEATURES)
    named = {f for name in _OTHERS for f in features_of(name)}
    return sorted(named | {r["name"] for r in best.collect()})


class Model:
    """Weights per feature, and the score of a set of features."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._held: dict[str, tuple] = {}

    def score(self, text: str) -> float:
        held, found = self._held, {}
        for word in set(_WORD.findall(text.lower())):
            own = held.get(word)
            if own is None:
                own = tuple((f, self.weights[f]) for f in features_of(word) if f in self.weights)
                if len(held) < HELD_WORDS:
                    held[word] = own
            if own:
                found.update(own)
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(found.values()), -60, 60))))


def fit(rows: list[tuple[int, list[int], list]], names: list[str]) -> Model:
    """Logistic weights with the swap penalty, by Adam. A sample of one label gives that label's share to all texts."""
    size = len(names)
    labels = np.array([r[0] for r in rows], dtype=float)
    if not len(labels):
        return Model({}, 0.0)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    column = np.array([c for r in rows for c in r[1]], dtype=np.int64)
    pairs = [p[:2] for r in rows for p in r[2]]
    times = np.array([p[2] for r in rows for p in r[2]], dtype=float)
    pair_owner = np.array([i for i, (gone, come) in enumerate(pairs) for _ in (*gone, *come)], dtype=np.int64)
    pair_column = np.array([c for gone, come in pairs for c in (*gone, *come)], dtype=np.int64)
    pair_sign = np.array([s for gone, come in pairs for s in (*[1.0] * len(gone), *[-1.0] * len(come))])
    # Both labels weigh the same in half of the loss, so that a rare label is learned.
    share = labels.mean()
    if share in (0.0, 1.0):
        return Model({}, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))))
    weight = 0.5 + 0.5 * np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    weight /= weight.sum()
    w, bias = np.zeros(size), float(np.log(share / (1 - share)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(owner, weights=w[column], minlength=len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels)
        grad = np.bincount(column, weights=error[owner], minlength=size) + DECAY * w
        if pairs:
            change = times * np.bincount(pair_owner, weights=pair_sign * w[pair_column], minlength=len(pairs))
            grad += SWAP_PENALTY / times.sum() * np.bincount(pair_column, weights=pair_sign * change[pair_owner], minlength=size)
        whole = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * whole, 0.99 * v + 0.01 * whole**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(dict(zip(names, w.tolist())), float(bias))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, held_out: int = 0) -> DataFrame:
    """(__id, __text, label) of at most ``bound`` labelled ids outside the held-out fold.

    Labels other than 0 and 1 are no labels; of several labels of an id the largest counts. Beyond the bound the ids with
    the smallest hashes are taken. The sample's bound also bounds its broadcast, so texts are not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__of"), F.col(label).cast("int").alias("label"))
    known = known.filter((crc_mod(F.col("__of"), FOLDS) != held_out) & F.col("label").isin(0, 1))
    known = known.groupBy("__of").agg(F.max("label").alias("label")).withColumn("__draw", F.pmod(F.xxhash64("__of"), F.lit(1 << 40)))
    n = known.count()
    if n > bound:
        # A little more than the bound by hash, so that only few rows are sorted.
        known = known.filter(F.col("__draw") < int(min(1.0, (1.1 * bound + 1000) / n) * (1 << 40)))
    known = known.orderBy("__draw", "__of").limit(bound)
    rows = texts(docs)
    return rows.join(F.broadcast(known), rows["__id"] == known["__of"]).select("__id", "__text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fit on the labels outside the held-out fold. Without labels every score is one half."""
    ready(docs.sparkSession)
    labelled = cut_lineage(labelled_rows(docs, labels, label, FIT_ROWS))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    names = choose(labelled, (sizes.get(0, 0), sizes.get(1, 0)))
    number = {name: i for i, name in enumerate(names)}

    def coded(batches):
        for ids, tags, bodies in batches:
            found = [sorted(number[f] for f in text_features(b) if f in number) for b in bodies]
            changed = [
                [{"gone": [number[f] for f in gone if f in number], "come": [number[f] for f in come if f in number], "times": n} for (gone, come), n in swaps(b).items()]
                for b in bodies
            ]
            yield [ids, tags, found, changed]

    # A row holds at most the chosen features, and the pairs of terms of a set that share features with a sentence or not.
    schema = "id long, label int, found array<int>, swaps array<struct<gone: array<int>, come: array<int>, times: int>>"
    rows = map_rows(labelled.select("__id", "label", "__text"), coded, schema).orderBy("id", "label").limit(FIT_ROWS).collect()
    return fit([(r["label"], r["found"], [(s["gone"], s["come"], s["times"]) for s in r["swaps"]]) for r in rows], names)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: null and empty texts get the model's bias, repeated rows the same score."""
    weights, bias = {f: w for f, w in model.weights.items() if w}, model.bias

    def run(batches):
        own = Model(weights, bias)
        for ids, bodies in batches:
            yield [ids, [own.score(b) for b in bodies]]

    return map_rows(texts(docs, key, text), run, "doc_id long, score double")


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores with the fold and the decision. A null id is in no fold: it counts as not held out."""
    return scores.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Toxicity of all documents. An empty table gives no rows; see ``train`` and ``score`` for odd rows."""
    return judged(score(docs, train(docs, labels)), threshold)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not toxic, in their own columns; the rejected go.

    A null or empty text is scored by the model's bias; repeated rows share their fate; an empty table gives no rows.
    """
    model = train(docs, labels)
    weights, bias = {f: w for f, w in model.weights.items() if w}, model.bias

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(weights, bias)
        for bodies in batches:
            yield bodies.map(own.score)

    return docs.filter(toxic(F.coalesce(F.col(text), F.lit(""))) < threshold)
