"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces reads a text once; at each place its output links give every piece that ends there, and
each relaxes the best score of the place by its own score and the best score of where it starts. A
character that is no piece costs ``UNKNOWN`` less than the worst piece and is spelled with byte pieces. Scores
are those of the model file, taken as a unigram model's: the segmentation has the highest sum of scores.

Spaces become marks and one mark is put in front; decoding undoes both. Literal marks (U+2581) of a text are spelled with
byte pieces, so every text comes back as it was. A piece of several marks is left out only where single marks always score
better, which changes no result; with a vocabulary where they don't, runs of marks stay together. No other piece
crosses a mark or a line break, and each distinct short stretch between them is encoded once per worker.

The model file at hand holds merge ranks as scores (minus the rank), not log-probabilities of a trained unigram model: the
segmentation is the best one under those scores.

Nulls: a null text is empty and has no ids; null ids decode to null. Repeated rows are encoded alike. Empty table: no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkwright.llm.common import ready, spread, table
from linkwright.llm.lattice import MARK, load

UNKNOWN = 10.0
#: Stretches of a worker that are remembered, and the longest of them.
REMEMBERED, SHORT = 800_000, 64
STRETCH = re.compile(f"{MARK}?[^{MARK}\n]+|{MARK}|\n")
WITH_MARKS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_CODECS: dict = {}


class Codec:
    def __init__(self, path: str | None = None):
        import ahocorasick

        self.vocabulary = load(path)
        self.automaton, scores = ahocorasick.Automaton(), []
        normal = {p: float(s) for p, k, s in zip(self.vocabulary.pieces, self.vocabulary.kinds, self.vocabulary.scores) if k == "normal"}
        single = normal.get(MARK, -math.inf)
        self.stretch = STRETCH
        for i, (piece, kind) in enumerate(zip(self.vocabulary.pieces, self.vocabulary.kinds)):
            if kind != "normal":
                continue
            if MARK in piece[1:]:
                if piece.strip(MARK) == "" and normal[piece] < single * len(piece):
                    continue  # as many single marks are always better
                self.stretch = WITH_MARKS if piece.lstrip(MARK).count(MARK) == 0 else re.compile(r"[^\n]+|\n")
            self.automaton.add_word(piece, (i, len(piece), normal[piece]))
            scores.append(normal[piece])
        self.automaton.make_automaton()
        self.unknown = min(scores) - UNKNOWN
        self.memory: dict[str, tuple[int, ...]] = {}
        self.byte_of = {int(i): b for b, i in enumerate(self.vocabulary.bytes) if i >= 0}
        self.literal_mark = self.vocabulary.bytes[list(MARK.encode())].tolist()

    def segment(self, text: str) -> tuple[float, list[tuple[int, int, int | None]]]:
        """The best score and (start, end, piece or None) of each part."""
        n = len(text)
        best, back = [0.0] + [-1e300] * n, [(0, None)] * (n + 1)
        done = 0  # places up to here have all their pieces
        single = False

        def close(until: int) -> None:
            """Characters that no piece of their own covers are unknown."""
            nonlocal done, single
            while done < until:
                if not single and best[done] + self.unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + self.unknown, (done, None)
                done, single = done + 1, False

        for last, (piece, length, score) in self.automaton.iter(text):
            close(last)
            start = last + 1 - length
            single = single or length == 1
            if best[start] + score > best[last + 1]:
                best[last + 1], back[last + 1] = best[start] + score, (start, piece)
        close(n)
        parts, at = [], n
        while at:
            start, piece = back[at]
            parts.append((start, at, piece))
            at = start
        return best[n], parts[::-1]

    def _ids(self, stretch: str) -> tuple[int, ...]:
        ids: list[int] = []
        for start, end, piece in self.segment(stretch)[1]:
            ids.extend([piece] if piece is not None else self.vocabulary.bytes[list(stretch[start:end].encode("utf-8", "surrogatepass"))].tolist())
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.memory
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += self.literal_mark
            for stretch in self.stretch.findall(MARK * (k == 0) + part.replace(" ", MARK)):
                ids = known.get(stretch)
                if ids is None:
                    ids = self._ids(stretch)
                    if len(stretch) <= SHORT:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[stretch] = ids
                out.extend(ids)
        return out

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        pieces, byte_of, out = self.vocabulary.pieces, self.byte_of, bytearray()
        for i in ids:
            if i in byte_of:
                out.append(byte_of[i])
            else:
                out += pieces[i].replace(MARK, " ").encode()
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str | None = None) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.decode(i.as_py()) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids and byte ids, their checksum, and whether decoding gives the text back."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        is_byte = np.zeros(len(own.vocabulary.pieces), bool)
        is_byte[list(own.byte_of)] = True
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                ids = own.encode(text)
                packed = np.array(ids, "<u4")
                rows.append((len(ids), int(is_byte[packed].sum()), zlib.crc32(packed.tobytes()), own.decode(ids) == text))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
