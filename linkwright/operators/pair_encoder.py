"""A trained text-pair scorer in numpy: a shared encoder, mean pooling and a linear logit.

A text is a sequence of hashed character trigrams of its words. Both texts of a pair go through the same embedding table and
are averaged; the logit is linear in their products and differences. Training is AdamW with warm-up, linear decay
and clipped gradients, over batches of pairs of like length. The training sample is bounded by a parameter; scoring runs
in Arrow batches on the executors (``models.second_scores``).

Larger encoders can take its place: whatever maps text pairs to logits is a scorer.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.functions.hashing import md5_mod
from linkwright.operators import diagnostics, models
from linkwright.operators.sampling import first_by_hash, pseudo_labels
from linkwright.session import stage

BUCKETS, WIDTH, TOKENS = 1 << 14, 32, 96
EPOCHS, BATCH, RATE, DECAY, WARM, CLIP = 8, 32, 2e-2, 1e-2, 0.03, 1.0
#: Pairs that an encoder is trained on at most.
MOST_PAIRS = 20_000


def tokens(text: str | None, most: int = TOKENS) -> list[int]:
    """Buckets of the trigrams of each word between marks; bucket 0 stands for an empty text."""
    own = [f"^{w}$" for w in (text or "").lower().split()]
    grams = [w[i : i + 3] for w in own for i in range(max(1, len(w) - 2))][:most]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1 for g in grams] or [0]


@lru_cache(1 << 14)
def _buckets(text: str | None) -> np.ndarray:
    return np.array(tokens(text))


def _flat(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All buckets in a row, and how many each text has."""
    own = [_buckets(t) for t in texts]
    return np.concatenate(own) if own else np.zeros(0, int), np.array([len(o) for o in own])


def _mean(table: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes) / sizes[:, None]


class PairEncoder:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {"table": rng.normal(0, 1, (BUCKETS, WIDTH)), "product": np.full(WIDTH, 0.5), "gap": np.full(WIDTH, -0.2), "bias": np.zeros(1)}
        self.seed = seed

    def _forward(self, pairs: Sequence[tuple[str | None, str | None]]):
        sides = [_flat([p[k] for p in pairs]) for k in (0, 1)]
        u, v = (_mean(self.p["table"], *s) for s in sides)
        return sides, u, v, self._logits(u, v)

    def _logits(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u * v) @ self.p["product"] + np.abs(u - v) @ self.p["gap"] + self.p["bias"][0]

    def __call__(self, pairs: Sequence[tuple[str | None, str | None]]) -> list[float]:
        """Logits; batches are cut so that texts of any number go through in bounded memory, and a batch encodes each of its texts once."""
        out: list[float] = []
        for i in range(0, len(pairs), 1024):
            own = pairs[i : i + 1024]
            place = {t: k for k, t in enumerate(dict.fromkeys(t for pair in own for t in pair))}
            means = _mean(self.p["table"], *_flat(list(place)))
            u, v = (means[[place[pair[k]] for pair in own]] for k in (0, 1))
            out += self._logits(u, v).tolist()
        return out

    def gradients(self, pairs: Sequence[tuple[str | None, str | None]], y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy and its gradients."""
        sides, u, v, z = self._forward(pairs)
        prob = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        d = (prob - y)[:, None] / len(y)
        sign = np.sign(u - v)
        by_text = d * (v * self.p["product"] + sign * self.p["gap"]), d * (u * self.p["product"] - sign * self.p["gap"])
        table = np.zeros_like(self.p["table"])
        for (flat, sizes), own in zip(sides, by_text):
            np.add.at(table, flat, np.repeat(own / sizes[:, None], sizes, axis=0))
        loss = float(np.mean(np.logaddexp(0, z) - y * z))
        return loss, {"table": table, "product": (d * u * v).sum(0), "gap": (d * np.abs(u - v)).sum(0), "bias": d.sum(0)}

    def train(self, pairs: Sequence[tuple[str | None, str | None]], y: Sequence[float], epochs: int = EPOCHS, rate: float = RATE) -> PairEncoder:
        y, rng = np.asarray(y, float), np.random.default_rng(self.seed)
        sizes = np.array([len(a or "") + len(b or "") for a, b in pairs])
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        total, step = epochs * -(-len(pairs) // BATCH), 0
        for _ in range(epochs):
            # like lengths share a batch; which batch comes when is random
            order = np.argsort(sizes + rng.random(len(sizes)), kind="stable")
            batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
            for at in rng.permutation(len(batches)):
                own = batches[at]
                _, grads = self.gradients([pairs[i] for i in own], y[own])
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                step += 1
                now = rate * min(step / max(1, WARM * total), (total - step + 1) / total)
                for k, g in grads.items():
                    g = g * min(1.0, CLIP / max(norm, 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + DECAY * self.p[k])
        return self

    def copy(self) -> PairEncoder:
        own = PairEncoder(self.seed)
        own.p = {k: a.copy() for k, a in self.p.items()}
        return own


def _sampled(pairs: DataFrame, texts: DataFrame, most: int) -> tuple[list[tuple[str, str]], list[float]]:
    """Texts and labels of at most ``most`` of ``pairs(q, p, y)``, drawn by hash; they reach the driver."""
    side = lambda k: texts.select(F.col("rid").alias(k), F.col("text").alias(f"_{k}")).hint("merge")
    rows = first_by_hash(pairs.select("q", "p", "y"), ["q", "p"], most).join(side("q"), "q").join(side("p"), "p").orderBy("q", "p").select("_q", "_p", "y").toArrow()
    return list(zip(rows["_q"].to_pylist(), rows["_p"].to_pylist())), rows["y"].to_pylist()


def fit(pairs: DataFrame, texts: DataFrame, most: int = MOST_PAIRS, seed: int = 0, base: PairEncoder | None = None, epochs: int = EPOCHS, rate: float = RATE) -> PairEncoder:
    """An encoder trained on labelled ``pairs(q, p, y)`` and ``texts(rid, text)``, from ``base`` on if there is one."""
    own, y = _sampled(pairs, texts, most)
    return (base.copy() if base else PairEncoder(seed)).train(own, y, epochs, rate)


def cross_fit(pairs: DataFrame, texts: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """Adds ce_logit to ``pairs(q, p, y, fold)``: model A learns from folds 1 and 2, B from 3 and 4, neither scores what it saw."""
    halves = {h: fit(pairs.where(F.col("fold").isin(*folds)), texts, most, seed) for seed, (h, folds) in enumerate({"A": (1, 2), "B": (3, 4)}.items())}
    return models.second_scores(pairs.withColumn("half", models.cross_fit_half(F.col("fold"), F.col("q"))), texts, halves)


def self_train(encoder: PairEncoder, labelled: DataFrame, target: DataFrame, texts: DataFrame, most: int = MOST_PAIRS, epochs: int = 1, rate: float = RATE / 10) -> DataFrame:
    """ce_logit of an unlabelled group's ``target(q, p, prob)`` after training on, at a low rate, with its own sure pairs and as many labelled ones."""
    sure = pseudo_labels(target).where("pseudo >= 0").select("q", "p", F.col("pseudo").alias("y"))
    pairs, y = _sampled(sure, texts, most // 2)
    more, more_y = _sampled(labelled, texts, most // 2)
    own = encoder.copy().train(pairs + more, y + more_y, epochs, rate) if pairs else encoder
    return models.second_scores(target.withColumn("half", F.lit("A")), texts, {"A": own}).drop("half")


def leave_group_out(pairs: DataFrame, texts: DataFrame, group: str, value, most: int = MOST_PAIRS) -> DataFrame:
    """ce_logit of one group's pairs by an encoder trained on all others."""
    encoder = fit(pairs.where(F.col(group) != value), texts, most)
    return models.second_scores(pairs.where(F.col(group) == value).withColumn("half", F.lit("A")), texts, {"A": encoder}).drop("half")


def gates(scored: DataFrame, scorer: models.Scorer | None = None) -> DataFrame:
    """(variant, log_loss, errors) of ``scored(q, p, y, prob, ce_logit)``: the first scores, the encoder's, and both combined by a logistic model, out of half."""
    scored = stage(scored, "encoded")  # two fits, two scorings and two losses read it
    rows = scored.withColumn("base_logit", models.logit(F.col("prob"))).withColumn("_half", md5_mod(F.col("q").cast("string"), 2))
    scorer, names = scorer or models.logistic(), ["base_logit", "ce_logit"]
    halves = [scorer.fit(rows.where(F.col("_half") == 1 - k).drop("prob"), names)(rows.where(F.col("_half") == k).drop("prob")) for k in (0, 1)]
    combined = halves[0].unionByName(halves[1])
    encoder = rows.withColumn("prob", 1 / (1 + F.exp(-F.col("ce_logit"))))
    parts = [diagnostics.log_loss(x).select(F.lit(n).alias("variant"), "log_loss", "errors") for n, x in (("first", rows), ("encoder", encoder), ("combined", combined))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
