"""Language-model scoring by subword lattice likelihood.

The model draws pieces of an existing vocabulary until it draws the end. A text's probability is the sum over
all segmentations into pieces; as no piece holds a word boundary but at its start, it is the product over
words of each word's sum, found by the forward recursion in log space. The vocabulary's own scores, ranks by
frequency, give the first weights (Zipf's law); ``ROUNDS`` of expectation maximisation over the words of the
training documents, weighted by their counts, give the final ones.

Texts are read once. Documents are grouped in blocks of ``BLOCK_BYTES`` as they are scanned; of each block the
distinct words and, for each document, the places of its words among them are stored. Counting, the lattice and
joining happen on distinct words, and each block gets back the figures of its own words alone.

Nulls: a null text is empty, a null id counts as the empty text in the split. A text without words is the end
alone. Repeated rows count each. Empty table: no rows. Without training documents all tokens are unknown and
the pieces keep their first weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm import lattice
from linkwright.llm.common import fold_of, materialise, ready, spread, table

BLOCK_BYTES = 8 << 20
ROUNDS = 2
#: Added to the expected count of each piece.
PRIOR = 0.5
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(text: str | None) -> list[bytes]:
    """Runs without space, tab, LF, VT, FF or CR; A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def blocks(docs: DataFrame, held_out: Column, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Document rows (doc_id, held_out, places, counts) and word rows (word, place, c) of every block."""
    schema = "block long, doc_id long, held_out boolean, n long, places binary, counts binary, word binary, place int, c long"
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, place = TaskContext.get().partitionId() << 24, 0, {}
        trained: list[int] = []
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            n, w = len(rows), len(place)
            columns = [*zip(*rows)] if rows else [()] * 5
            null = lambda k, t: pa.nulls(k, t)
            data = [pa.array(c, t) for c, t in zip(columns, types[1:6])]
            full = [pa.array(np.full(n + w, block))]
            full += [pa.concat_arrays([d, null(w, t)]) for d, t in zip(data, types[1:6])]
            full += [pa.concat_arrays([null(n, types[6]), pa.array(list(place), types[6])]), pa.concat_arrays([null(n, types[7]), pa.array(np.arange(w, dtype=np.int32))]), pa.concat_arrays([null(n, types[8]), pa.array(trained, types[8])])]
            return pa.RecordBatch.from_arrays(full, names=names)

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                own = Counter(words)
                places = [place.setdefault(w, len(place)) for w in own]
                trained.extend([0] * (len(place) - len(trained)))
                if not held:
                    for p, c in zip(places, own.values()):
                        trained[p] += c
                rows.append((doc_id, held, len(words), np.array(places, "<u4").tobytes(), np.array(list(own.values()), "<u4").tobytes()))
                size += sum(map(len, words))
                if size >= block_bytes:
                    yield out()
                    block, size, place, trained, rows = block + 1, 0, {}, [], []
        if rows:
            yield out()

    return spread(docs.select("doc_id", "text", held_out.alias("held_out"))).mapInArrow(run, schema)


def first_weights(vocabulary: lattice.Vocabulary) -> np.ndarray:
    """Log probabilities from the vocabulary's scores (minus a rank): Zipf's law; byte pieces are the rarest; the end is the last."""
    usable = vocabulary.usable()
    rank = np.where(vocabulary.scores <= 0, -vocabulary.scores, 0.0)
    rank[vocabulary.bytes[vocabulary.bytes >= 0]] = rank[usable & (rank < 1e8)].max() + 1
    weight = np.append(np.where(usable, 1 / (rank + 2), 0), 1 / (len(rank) + 2))
    with np.errstate(divide="ignore"):
        return np.log(weight / weight.sum())


def reestimate(words: DataFrame, n_docs: int, rounds: int = ROUNDS, vocabulary: str | None = None) -> np.ndarray:
    """Log probabilities of pieces (by id) and, last, the end, after expectation maximisation over ``words(word, c)``."""
    spark = words.sparkSession
    own = lattice.load(vocabulary)
    logp, usable = first_weights(own), np.append(own.usable(), True)
    for _ in range(rounds if n_docs else 0):
        sent = spark.sparkContext.broadcast(logp)  # as long as the vocabulary

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces, found = lattice.load(vocabulary), 0
            for batch in batches:
                texts = [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
                found = found + lattice.expected_counts(texts, batch.column(1).to_numpy().astype(float), pieces, sent.value[:-1])
            if not isinstance(found, int):
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["piece", "uses"])

        uses = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()  # one row a piece at most
        counts = np.zeros(len(logp))
        for r in uses:
            counts[r.piece] = r.uses
        counts[-1] = n_docs
        counts = np.where(usable, counts + PRIOR, 0)
        with np.errstate(divide="ignore"):
            logp = np.log(counts / counts.sum())
        sent.unpersist()
    return logp


def score_documents(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every row of ``docs(doc_id, text)``; rows where ``held_out`` is true are not learnt from."""
    spark = ready(docs.sparkSession)
    stored = materialise(blocks(docs, held_out, block_bytes), "lm-blocks")
    in_block = stored.where("place IS NOT NULL").select("block", "place", "word", "c")
    counted = materialise(in_block.groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    n_docs = stored.where("place IS NULL AND NOT held_out").count()
    totals = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = totals.n + n_docs, totals.v + (n_docs > 0)
    logp = reestimate(counted, n_docs, rounds, vocabulary)
    sent = spark.sparkContext.broadcast(logp)
    ten = math.log(10)

    def base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice.load(vocabulary)
        for batch in batches:
            texts = [w.decode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()]
            lp = lattice.log_probabilities(texts, pieces, sent.value[:-1]) / ten
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

    weighed = counted.select("word", "c").mapInArrow(weigh, "word binary, c long, lp double")
    figures = in_block.select("block", "place", "word").join(weighed, "word").select(F.col("block").alias("in_block"), "place", "c", "lp")
    rows = stored.where("place IS NULL").select("block", "doc_id", "held_out", "n", "places", "counts")
    end_base, end_score = float(base(np.array([n_docs]))[0]), float(logp[-1]) / ten
    names = [f.split()[0] for f in OUT.split(", ")]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        known, bases, scores = np.zeros(size), np.zeros(size), np.zeros(size)
        at = right.column("place").to_numpy()
        c = right.column("c").to_numpy()
        known[at], bases[at], scores[at] = c > 0, base(c), right.column("lp").to_numpy()
        sums = np.zeros((left.num_rows, 3))
        for i, (p, k) in enumerate(zip(left.column("places"), left.column("counts"))):
            p, k = np.frombuffer(p.as_py(), "<u4"), np.frombuffer(k.as_py(), "<u4").astype(float)
            sums[i] = k @ known[p], k @ bases[p], k @ scores[p]
        tokens = left.column("n").to_numpy() + 1
        n_known = sums[:, 0].astype(np.int64) + (n_docs > 0)
        columns = [left.column("doc_id"), left.column("held_out"), tokens, n_known, np.full(len(tokens), n, np.int64), sums[:, 1] + end_base, sums[:, 2] + end_score]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], names=names)

    return rows.groupBy("block").cogroup(figures.groupBy("in_block")).applyInArrow(finish, OUT)


def op8_subword_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id")) == 1)
