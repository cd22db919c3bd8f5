"""Toxicity by class-conditional Kneser-Ney models.

Two models, of the running text of toxic and of ordinary documents, give each character's probability after those
before it, across word boundaries, and back off to shared counts (``kneser_ney``), so that what is rare in both
weighs the same. The log-likelihoods of both are compared by passages of one to ``PASSAGE`` words, normalised by
their length in characters (``LEAST`` at least, about a word, so that one of two or three letters isn't all). A document is as toxic as its
most toxic passage, since one insult among thousands of words decides. A logistic curve over that one
difference, fitted on differences by models that haven't seen the document, turns it into a probability.

Nulls: a null text is empty; texts without words get the score of no difference. Labels: see ``labelled.sample``. Without labels
of both classes every score is the share of label 1. Repeated rows get equal scores. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import kneser_ney
from linkwright.llm.common import chunks, ready, spread, table
from linkwright.llm.labelled import PER_CLASS, Logistic, halves, held_out, sample, weights_for

THRESHOLD = 0.5
PASSAGE, LEAST = 3, 6
#: Log ratios are added as whole numbers of this part of one.
UNIT = float(1 << 32)


def passage_differences(model: kneser_ney.Model, alphabet: kneser_ney.Alphabet, texts: list[str | None]) -> np.ndarray:
    """Of each text the highest difference of length-normalised log-likelihoods of a passage; 0 without words."""
    out = np.full(len(texts), -np.inf)
    for places, parts in kneser_ney.stretches(texts):
        grams, ends, part = alphabet.grams(parts)
        if not len(grams):
            continue
        last = np.flatnonzero(ends)
        whole = np.round(model.ratios(grams) * UNIT).astype(np.int64)  # sums don't depend on what stands before
        total = np.concatenate([[0], np.cumsum(whole)[last]])
        size = np.concatenate([[0], last + 1])
        text = np.array(places)[part[last]]
        own = part[last]
        for n in range(1, PASSAGE + 1):
            same = own[n - 1 :] == own[: len(own) - n + 1]
            value = (total[n:] - total[:-n]) / UNIT / np.maximum(size[n:] - size[:-n], LEAST)
            np.maximum.at(out, text[n - 1 :][same], value[same])
    return np.where(np.isfinite(out), out, 0.0)


class Classifier:
    """Fitted on the driver on a bounded sample; broadcast to the executors."""

    def __init__(self, texts: list[str], y: np.ndarray, prior: float):
        self.prior, self.model, self.link = prior, None, None
        if len(set(y.tolist())) < 2:
            return
        self.alphabet = kneser_ney.Alphabet(texts)
        fold, x = halves(len(y)), np.zeros((len(y), 1))
        chosen = {(k, label): np.flatnonzero((fold == k) & (y == label)) for k in (0, 1) for label in (0, 1)}
        counts = {cell: self.alphabet.counts([texts[i] for i in own]) for cell, own in chosen.items()}
        for k in (0, 1):
            if len(chosen[1 - k, 0]) and len(chosen[1 - k, 1]):
                other = kneser_ney.Model(counts[1 - k, 1], counts[1 - k, 0])
                own = np.flatnonzero(fold == k)
                x[own, 0] = passage_differences(other, self.alphabet, [texts[i] for i in own])
        self.link = Logistic(x, y, weights_for(y, prior))
        self.model = kneser_ney.Model(*(kneser_ney.combined(counts[0, label], counts[1, label]) for label in (1, 0)))

    def scores(self, texts: list[str | None], memory: dict | None = None) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        return self.link(passage_differences(self.model, self.alphabet, texts)[:, None])


def score(docs: DataFrame, classifier, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; ``classifier`` has ``scores(texts, memory)``."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in chunks(texts):
                found = sent.value.scores(texts[a:b], memory)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return spread(docs.select("doc_id", held_out().alias("held_out"), "text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, classifier, threshold: float, wanted: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are predicted ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in chunks(texts):
                predicted = sent.value.scores(texts[a:b], memory) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(predicted == wanted))

    return spread(docs).mapInArrow(run, docs.schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Classifier:
    return Classifier(*sample(docs, labels, label, per_class))


def op9_toxicity_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)
