"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best fit by classes. Lengths and gaps are integers of at most ``capacity``, so range-sorting
documents and gaps puts them into at most ``capacity`` classes each. A round takes the longest
class still unplaced and sweeps upwards through the sorted gaps from its successor, the smallest gap
that holds it; of several pieces that want the same gap, the rank inside the class decides: piece
number k of the class takes gap number k of the run. Then the gaps are updated and the next
round starts. The rounds see counts only, at most ``capacity`` numbers whatever the corpus, so they run on the
driver; ranks and places are worked out where the pieces are, on the executors. The result is that of best fit on
single pieces in decreasing order (tests compare the two). The rounds are not distributed sweeps over single documents:
with one match for each gap in a round those need more sequences and many more rounds (figures in the README).

Nulls: a null text is an empty one and packs as a single end id; a null id is kept.
Empty table: no rows. Repeated rows are packed each. Ties of length go by rank.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.llm.common import materialise, ready, spread, table

CAPACITY = 1024
END_ID = 2
#: Steps of a plan that are broadcast.
MOST_STEPS = 1 << 18
_ENCODERS: dict = {}


class ByteBpe:
    """Byte-level BPE encoder of the 50k vocabulary: the ids of ``tokenizers`` with byte_bpe_50k.json.

    The rank file holds the same vocabulary, and its encoder gives the same ids several times as fast. Two kinds of texts go to
    ``tokenizers`` itself: those that hold the string of an added token, which is one id there, and those that the rank
    file's pattern refuses (white space of about a million characters). Tests compare the two.
    """

    def __init__(self, path: str | None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole_path = str(Path(path).with_suffix(".json")) if path else public_tokenizers.path("byte_bpe_50k.json")
        added = [t["content"] for t in json.loads(Path(self.whole_path).read_text(encoding="utf-8")).get("added_tokens", [])]
        self.holds_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.whole_path)

    def encode(self, text: str) -> np.ndarray:
        if not self.holds_added(text):
            try:
                return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=())
            except ValueError:  # the pattern's stack is full
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def byte_bpe(path: str | None = None) -> ByteBpe:
    """The encoder; ``path`` is another rank file, beside which its .json lies."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path)
    return _ENCODERS[path]


def token_ids(text: str | None, encoder: ByteBpe, end_id: int = END_ID) -> np.ndarray:
    return np.append(encoder.encode(text or "").astype("<u4"), np.array([end_id], "<u4"))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, but for the first if ``n`` is no multiple."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenise(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in this task (``task``)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = byte_bpe(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py(), encoder, end_id)
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own.tobytes()), task, seen[length]) + (own.tolist(),) * with_ids)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [()] * len(fields), fields)], names=[n for n, _ in fields])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): rank ``first + i`` goes to sequence ``first sequence + i``."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    placed, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            gap = next((g for g in range(size, capacity + 1) if gaps[g]), 0)
            if gap:
                at, n = gaps[gap].pop()
            else:  # no gap holds it: as many new sequences as the rest of the class fills
                gap, at, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = gap // size  # a gap takes pieces until it holds no more; the last one taken from may keep room
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for layer in range(each if full else 0):
                placed.append((size, rank, rank + full, at, capacity - gap + layer * size))
                rank += full
            for layer in range(rest):
                placed.append((size, rank, rank + 1, at + full, capacity - gap + layer * size))
                rank += 1
            for g, start, k in ((gap - each * size, at, full), (gap - rest * size, at + full, min(1, rest)), (gap, at + full + min(1, rest), n - full - min(1, rest))):
                if g and k:
                    gaps[g].append((start, k))
            left -= full * each + rest
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have ``length``, ``task`` and ``rank``."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    # The plan's size is bound by the capacity, not by the corpus; a longer one than is good to broadcast is joined by length.
    placed = plan(counts, capacity)
    steps = spark.createDataFrame(placed, "size int, lo long, hi long, first_sequence long, offset long")
    steps = F.broadcast(steps) if len(placed) <= MOST_STEPS else steps
    ranked = pieces.join(by_task.select("length", "task", "before"), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before"))
    return ranked.join(steps, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("lo"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenises and packs ``docs(doc_id, text)``; ``with_ids`` also returns the token ids of each piece."""
    ready(docs.sparkSession)
    pieces = materialise(tokenise(docs, capacity, end_id, vocabulary, with_ids), "packing-pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
