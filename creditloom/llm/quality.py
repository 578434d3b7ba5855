"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention, learned from document labels alone, says
how much each counts; the score is that of the weighted passage representation.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, functions as F

from creditloom.llm.base import map_rows, ready, texts
from creditloom.llm.toxicity import judged, labelled_rows
from creditloom.session import cut_lineage

PASSAGE_WORDS = 64
# The model is fitted on at most this many labelled rows.
FIT_ROWS = 4_000
# Buckets of hashed word endings beside the counted traits; width of the encoding and of the attention.
ENDINGS = 32
WIDTH = 24
ATTENTION = 12
STEPS = 300
SEED = 5

# Byte classes whose shares describe a passage.
_CLASSES = np.zeros((256, 16), dtype=np.float64)
for _i, _members in enumerate(
    ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", ".", ",", "!", "?", "|", "#$%&*", "()[]{}<>", "'\"", "@", "/\\_=+~^`", ":;-")
):
    for _c in _members:
        _CLASSES[ord(_c), _i] = 1
_CLASSES[128:, 15] = 1
TRAITS = _CLASSES.shape[1] + 6 + ENDINGS


@lru_cache(maxsize=1 << 16)
def _bucket(ending: str) -> int:
    return zlib.crc32(ending.encode("utf-8", "surrogatepass")) % ENDINGS


def passages(text: str) -> np.ndarray:
    """Traits of all passages of a text; one row of zeros for a text without words."""
    words = text.split()
    if not words:
        return np.zeros((1, TRAITS))
    rows = np.zeros((-(-len(words) // PASSAGE_WORDS), TRAITS))
    for number, at in enumerate(range(0, len(words), PASSAGE_WORDS)):
        own = words[at : at + PASSAGE_WORDS]
        raw = np.frombuffer(" ".join(own).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        row, n = rows[number], len(own)
        row[:16] = np.bincount(raw, minlength=256) @ _CLASSES / len(raw)
        row[16] = sum(map(eq, own, own[1:])) / n
        row[17] = len(set(own)) / n
        row[18] = min(len(raw) / n / 10, 3.0)
        row[19] = n / PASSAGE_WORDS
        row[20] = sum(map(str.isupper, own)) / n
        row[21] = sum(map(str.isalpha, own)) / n
        row[22:] = np.bincount([_bucket(w[-2:]) for w in own], minlength=ENDINGS) / n
    return rows


class Model:
    """encoding h = tanh(x W + b); attention softmax(w · (tanh(h V) * sigmoid(h U))); score sigmoid(c · sum(a h) + d)."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts

    @classmethod
    def start(cls, rows: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        return cls(
            {
                "mean": rows.mean(axis=0), "scale": 1 / (rows.std(axis=0) + 0.02),
                "W": draw(TRAITS, WIDTH), "b": np.zeros(WIDTH), "V": draw(WIDTH, ATTENTION), "U": draw(WIDTH, ATTENTION),
                "w": draw(ATTENTION), "c": draw(WIDTH), "d": np.zeros(1),
            }
        )

    def forward(self, rows: np.ndarray, bag: np.ndarray, bags: int):
        p = self.parts
        x = np.clip((rows - p["mean"]) * p["scale"], -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, e)
        raw = np.exp(e - top[bag])
        a = raw / np.bincount(bag, weights=raw, minlength=bags)[bag]
        ends = np.flatnonzero(np.append(np.diff(bag), 1))
        z = np.diff(np.vstack((np.zeros(h.shape[1]), np.cumsum(a[:, None] * h, axis=0)[ends])), axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -60, 60)))
        return x, h, t, g, a, z, y

    def score(self, text: str) -> float:
        rows = passages(text)
        return float(self.forward(rows, np.zeros(len(rows), dtype=np.int64), 1)[-1][0])

    def gradients(self, rows, bag, labels, weight):
        p = self.parts
        x, h, t, g, a, z, y = self.forward(rows, bag, len(labels))
        dy = weight * (y - labels)
        dz = dy[:, None] * p["c"]
        da = (h * dz[bag]).sum(axis=1)
        de = a * (da - np.bincount(bag, weights=a * da, minlength=len(labels))[bag])
        dt, dg = de[:, None] * g * p["w"] * (1 - t**2), de[:, None] * t * p["w"] * g * (1 - g)
        dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h**2)
        return {
            "W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": de @ (t * g), "c": dy @ z, "d": dy.sum(keepdims=True),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray) -> Model:
    """Adam over the whole sample. Classes weigh by the root of their shares, so a rare class is learned without drowning the other."""
    rows, bag = np.vstack(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    model, share = Model.start(rows), labels.mean()
    weight = np.ones(len(labels))
    if 0 < share < 1:
        weight = np.where(labels > 0, 1 / np.sqrt(share), 1 / np.sqrt(1 - share))
    weight /= weight.sum()
    names = ("W", "b", "V", "U", "w", "c", "d")
    m, v = ({n: np.zeros_like(model.parts[n]) for n in names} for _ in range(2))
    for step in range(1, STEPS + 1):
        grads = model.gradients(rows, bag, labels, weight)
        for n in names:
            grad = grads[n] + 1e-4 * model.parts[n]
            m[n], v[n] = 0.9 * m[n] + 0.1 * grad, 0.999 * v[n] + 0.001 * grad**2
            model.parts[n] = model.parts[n] - 0.02 * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Fit on a sample of the labels outside the held-out fold; None without labels."""
    ready(docs.sparkSession)
    labelled = labelled_rows(docs, labels, label, FIT_ROWS)

    def traits(batches):
        for ids, tags, bodies in batches:
            yield [ids, tags, [passages(b).astype("<f4").tobytes() for b in bodies]]

    coded = cut_lineage(map_rows(labelled.select("__id", "label", "__text"), traits, "id long, label int, bag binary"))
    rows = coded.orderBy(F.xxhash64("id"), "label").limit(FIT_ROWS).collect()
    if not rows:
        return None
    bags = [np.frombuffer(r["bag"], dtype="<f4").reshape(-1, TRAITS).astype(np.float64) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], dtype=np.float64))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row. A null or empty text is one passage of nothing; without labels scores are one half."""

    def run(batches):
        for ids, bodies in batches:
            yield [ids, [model.score(b) if model else 0.5 for b in bodies]]

    return map_rows(texts(docs, key, text), run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Quality of all documents; repeated rows get the same score, an empty table gives no rows."""
    return judged(score(docs, train(docs, labels)), threshold)
