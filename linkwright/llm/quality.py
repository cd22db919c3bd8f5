"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse ternary index vector, drawn from its hash. A word's vector is its own index vector and the
sum of those of its neighbours in the sample, both of length one. Frequent words of the sample have
vectors of their own; a rarer or unseen word has that of its shape (case, digits, punctuation), and a word that
repeats the one before has that of a repetition. A document is the mean of its words' vectors and the spread
of its parts' means; the network has one hidden layer, and its temperature is fitted on documents kept aside.

Nulls: a null text is empty; empty texts get the score of the zero vector. Labels: see ``labelled.sample``. Without labels
of both classes every score is the share of label 1. Repeated rows get equal scores. Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from linkwright.llm.common import ready, table
from linkwright.llm.labelled import PER_CLASS, sample, sigmoid, weights_for
from linkwright.llm.toxicity import score

THRESHOLD = 0.3
WIDTH = 64
NONZERO = 4
WINDOW = 2
#: Documents of the sample that a word must be in to have a vector of its own, and the most such words.
FREQUENT, WORDS = 20, 20_000
SHAPES = 4_000
HIDDEN = 32
#: Tokens of the parts whose spread is a feature.
PART = 64
EPOCHS, BATCH, RATE, DECAY = 30, 64, 2e-3, 1e-4
REMEMBERED = 500_000
SAME, UNKNOWN = "\0same", "\0unknown"


def shape(token: str) -> str:
    """Case, digits and punctuation: runs of letters and digits are one sign, other characters stay (three of a kind at most)."""
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0].isupper() and len(m[0]) > 1 else "Xx" if m[0][0].isupper() else "x", token)
    s = re.sub(r"\d+", "9", s)
    return "\0" + re.sub(r"(.)\1{3,}", r"\1\1\1", s)[:12]


def index_vector(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components."""
    h = xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), 5)
    places, signs = [], []
    while len(places) < NONZERO:
        place = h % WIDTH
        if place not in places:
            places.append(place)
            signs.append(1.0 if h >> 32 & 1 else -1.0)
        h = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 5)
    return np.array(places), np.array(signs)


class Vectors:
    """Names (words, shapes, the repetition) with numbers and vectors."""

    def __init__(self, texts: list[str]):
        spread = Counter()
        for t in texts:
            spread.update(set(t.split()))
        frequent = sorted((w for w, n in spread.items() if n >= FREQUENT), key=lambda w: (-spread[w], w))[:WORDS]
        kinds = Counter()
        for w, n in spread.items():
            kinds[shape(w)] += n
        del spread
        names = [UNKNOWN, SAME, *frequent, *sorted(kinds, key=lambda k: (-kinds[k], k))[:SHAPES]]
        self.number = {n: i for i, n in enumerate(names)}
        places = np.stack([index_vector(n)[0] for n in names])
        signs = np.stack([index_vector(n)[1] for n in names])
        own = np.zeros((len(names), WIDTH))
        np.put_along_axis(own, places, signs, 1)
        context, memory = np.zeros(len(names) * WIDTH), {}
        for t in texts:
            ids = self.numbers(t.split(), memory)
            for d in range(1, WINDOW + 1):
                for a, b in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
                    for k in range(NONZERO if len(a) else 0):
                        np.add.at(context, a * WIDTH + places[b, k], signs[b, k])
        context = context.reshape(len(names), WIDTH)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        self.table = (unit(own) + unit(context)).astype(np.float32)

    def numbers(self, tokens: list[str], memory: dict[str, int]) -> np.ndarray:
        if len(memory) > REMEMBERED:
            memory.clear()
        own = []
        for t in tokens:
            n = memory.get(t)
            if n is None:
                n = memory[t] = self.number[t] if t in self.number else self.number.get(shape(t), 0)
            own.append(n)
        ids = np.array(own, np.int64)
        if len(ids) > 1:  # a repetition is one of the word itself, not of its shape
            same = np.fromiter(map(str.__eq__, tokens[1:], tokens), bool, len(tokens) - 1)
            ids[1:][same] = self.number[SAME]
        return ids

    def pool(self, ids: np.ndarray) -> np.ndarray:
        """Mean vector, and per component the spread of the means of parts of the text."""
        if not len(ids):
            return np.zeros(2 * WIDTH, np.float32)
        ends = np.arange(0, len(ids), PART)
        sizes = np.diff(np.append(ends, len(ids)))
        sums = np.concatenate([np.add.reduceat(self.table[ids[a : a + 512 * PART]], np.arange(0, min(512 * PART, len(ids) - a), PART)) for a in range(0, len(ids), 512 * PART)])
        means = sums / sizes[:, None]
        return np.concatenate([sums.sum(0) / len(ids), np.sqrt((sizes[:, None] * (means - sums.sum(0) / len(ids)) ** 2).sum(0) / len(ids))])


class Network:
    """Two layers in numpy, trained by Adam on weighted cross-entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(0), x.std(0) + 1e-3, 1.0
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for a in range(0, len(z), BATCH):
                i = order[a : a + BATCH]
                h = np.maximum(z[i] @ p[0] + p[1], 0)
                g = w[i] * (sigmoid(h @ p[2] + p[3][0]) - y[i]) / len(i)
                back = np.outer(g, p[2]) * (h > 0)
                grads = [z[i].T @ back + DECAY * p[0], back.sum(0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
                step += 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = p

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def calibrate(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
        """The temperature, of at least 1, with the least cross-entropy on documents that weren't trained on."""
        logits = self.logits(x)
        loss = lambda t: -(w * np.log(np.where(y == 1, sigmoid(logits / t), sigmoid(-logits / t)) + 1e-12)).sum()
        self.temperature = min(np.geomspace(1, 10, 47), key=loss)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


class Classifier:
    def __init__(self, texts: list[str], y: np.ndarray, prior: float):
        self.prior, self.network = prior, None
        if len(set(y.tolist())) < 2:
            return
        self.vectors = Vectors(texts)
        memory: dict = {}
        x = np.stack([self.vectors.pool(self.vectors.numbers(t.split(), memory)) for t in texts])
        w = weights_for(y, prior)
        aside = np.arange(len(y)) % 5 == 0
        if len(set(y[~aside].tolist())) < 2:
            aside[:] = False
        self.network = Network(x[~aside], y[~aside], w[~aside])
        if aside.any():
            self.network.calibrate(x[aside], y[aside], w[aside])

    def scores(self, texts: list[str | None], memory: dict[str, int]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return self.network(np.stack([self.vectors.pool(self.vectors.numbers((t or "").split(), memory)) for t in texts]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Classifier:
    return Classifier(*sample(docs, labels, label, per_class))


def op5_quality_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)
