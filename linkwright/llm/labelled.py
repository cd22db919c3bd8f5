"""A bounded sample of labelled documents to fit a classifier on, and the pieces that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import fold_of, materialise

#: Labelled documents of each class that a classifier is fitted on at most; they are those with the smallest id hashes.
PER_CLASS = 2_000
#: Bytes of text of each class after which no further document is taken, whatever the lengths of the single ones.
CLASS_BYTES = 32 << 20


def held_out(doc_id=None):
    return fold_of(F.col("doc_id") if doc_id is None else doc_id) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> tuple[list[str], np.ndarray, float]:
    """Texts, their 0/1 labels and the share of label 1 among all labelled documents outside the held-out fold.

    Labels are joined with the documents first (ids, text hashes and sizes alone), so labels of other documents count for
    nothing. Of each class those with the smallest id hashes are taken, ``per_class`` at most, until they hold
    ``class_bytes``; a long text is taken like any other, so the driver gets ``2 * class_bytes`` and two texts at
    most. Rows with a null id or label aren't labelled; of several labels of an id the largest counts, of several texts
    that with the smallest hash.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    text = F.coalesce("text", F.lit(""))
    sized = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(text).alias("h"), F.octet_length(text).alias("n"))).alias("t"))
    known = materialise(sized.join(own, "doc_id").select("doc_id", "y", "t.h", "t.n"), "labelled")
    prior = known.agg(F.coalesce(F.avg("y"), F.lit(0.5))).first()[0]
    chosen = []
    for y in (0, 1):
        size = 0
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            if size >= class_bytes:
                break
            chosen.append((r.doc_id, r.y, r.h))
            size += r.n
    both = F.broadcast(docs.sparkSession.createDataFrame(chosen, "__id long, __y int, __h long"))  # 2 * per_class rows at most
    rows = docs.select("doc_id", text.alias("text")).join(both, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__h")))
    found = rows.groupBy("__id").agg(F.min(F.struct("text", F.col("__y").alias("y"))).alias("r")).select("r.text", "r.y").orderBy(F.xxhash64("text"), "text").toArrow()
    return found["text"].to_pylist(), found["y"].to_numpy().astype(np.int64), float(prior)


def halves(n: int) -> np.ndarray:
    """Alternating folds 0 and 1; the sample's order is that of a hash."""
    return np.arange(n) % 2


def weights_for(y: np.ndarray, prior: float) -> np.ndarray:
    """Weights that give the sample's classes the shares they have among all labelled rows."""
    share = y.mean() if len(y) else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Logistic:
    """Logistic regression on standardised features, by Newton steps with an L2 penalty."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0, steps: int = 30):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        self.beta = np.zeros(z.shape[1])
        ridge = np.diag([penalty] * x.shape[1] + [1e-3])
        for _ in range(steps):
            p = sigmoid(z @ self.beta)
            h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge
            self.beta += np.linalg.solve(h, z.T @ (w * (y - p)) - ridge @ self.beta)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.beta)
