"""Subword lattices in numpy: all segmentations of many words at once.

A word is the boundary mark and its characters; an arc is a piece of the vocabulary that matches at a place. A
character that is no piece itself gets one arc made of its UTF-8 bytes' pieces. ``Vocabulary.arcs`` walks a trie
from all places of all words in step and drops places whose prefix leads nowhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

MARK = "▁"
NONE = -1
#: Cells (words x places) of one array pass.
CELLS = 1 << 17
#: Places beyond which a word goes by itself.
LONG = 2_000
_LOADED: dict = {}


class Vocabulary:
    """Pieces of a sentencepiece model with their scores; ids as in the model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        self.scores = np.array(scores)
        self.bytes = np.full(256, NONE)
        nodes, keys, values = {"": 0}, [], []
        self.node_piece = [NONE]
        for i, (piece, kind) in enumerate(zip(pieces, kinds)):
            if kind == "byte":
                self.bytes[int(piece[3:5], 16)] = i
            if kind != "normal":
                continue
            for n in range(1, len(piece) + 1):
                if piece[:n] not in nodes:
                    nodes[piece[:n]] = len(nodes)
                    keys.append(nodes[piece[: n - 1]] << 21 | ord(piece[n - 1]))
                    values.append(nodes[piece[:n]])
                    self.node_piece.append(NONE)
            self.node_piece[nodes[piece]] = i
        order = np.argsort(keys)
        self.keys, self.values = np.array(keys)[order], np.array(values)[order]
        self.node_piece = np.array(self.node_piece)
        self.longest = max(map(len, pieces))

    def usable(self) -> np.ndarray:
        """Ids that a segmentation may contain."""
        own = np.zeros(len(self.pieces), bool)
        own[self.node_piece[self.node_piece >= 0]] = True
        own[self.bytes[self.bytes >= 0]] = True
        return own

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """``codes`` (words, places), NONE beyond a word's end -> for each arc length the piece ids by start, or NONE."""
        n, places = codes.shape
        node = np.zeros(n * places, np.int64)
        active = np.flatnonzero(codes.ravel() >= 0)
        flat, column = codes.ravel(), np.tile(np.arange(places), n)
        out = []
        for length in range(1, min(self.longest, places) + 1):
            active = active[column[active] + length <= places]
            active = active[flat[active + length - 1] >= 0]
            key = node[active] << 21 | flat[active + length - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            active = active[hit]
            node[active] = self.values[at[hit]]
            own = np.full(n * places, NONE, np.int64)
            own[active] = self.node_piece[node[active]]
            out.append(own.reshape(n, places))
            if not len(active):
                break
        return out


def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a sentencepiece model file; kept per process."""
    import public_tokenizers
    import sentencepiece

    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _LOADED:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        kinds = ["byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal" for i in ids]
        _LOADED[path] = Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)
    return _LOADED[path]


def batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length: (their positions, code points with the mark in front, lengths)."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and sizes[order[start]] <= LONG and sizes[order[min(end + 63, len(order) - 1)]] * (end + 64 - start) <= CELLS and end < len(order):
            end = min(end + 64, len(order))
        own = order[start:end]
        lengths = sizes[own]
        codes = np.full((len(own), int(lengths[-1])), NONE, np.int64)
        codes[:, 0] = ord(MARK)
        joined = np.frombuffer("".join(words[i] for i in own).encode("utf-32-le", "surrogatepass"), "<u4")
        row = np.repeat(np.arange(len(own)), lengths - 1)
        first = np.cumsum(lengths - 1) - (lengths - 1)
        codes[row, np.arange(len(joined)) - np.repeat(first, lengths - 1) + 1] = joined
        yield own, codes, lengths
        start = end


class Lattice:
    """The arcs of one batch with their log weights under ``logp`` (by piece id)."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray, logp: np.ndarray):
        self.vocabulary, self.codes, self.lengths = vocabulary, codes, lengths
        self.ids = vocabulary.arcs(codes)
        self.weights = [np.where(ids >= 0, logp[ids], -np.inf) for ids in self.ids]
        self.fallback = (self.ids[0] == NONE) & (codes >= 0)
        self.spelled = {int(c): vocabulary.bytes[list(chr(c).encode("utf-8", "surrogatepass"))] for c in np.unique(codes[self.fallback])}
        if self.spelled:
            chars = np.array(sorted(self.spelled))
            by_char = np.array([logp[self.spelled[int(c)]].sum() for c in chars])
            self.weights[0][self.fallback] = by_char[np.searchsorted(chars, codes[self.fallback])]

    def forward(self) -> np.ndarray:
        """(words, places + 1): log probability of all ways to each place."""
        n, places = self.codes.shape
        alpha = np.full((n, places + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, places + 1):
            alpha[:, j] = _log_sum([alpha[:, j - k] + self.weights[k - 1][:, j - k] for k in range(1, min(j, len(self.weights)) + 1)])
        return alpha

    def total(self, alpha: np.ndarray) -> np.ndarray:
        return alpha[np.arange(len(alpha)), self.lengths]

    def expected(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Expected uses of each piece, words weighted by ``counts``."""
        n, places = self.codes.shape
        alpha = self.forward()
        total = self.total(alpha)
        beta = np.full((n, places + 1), -np.inf)
        beta[np.arange(n), self.lengths] = 0
        for i in range(places - 1, -1, -1):
            ways = [beta[:, i + k] + self.weights[k - 1][:, i] for k in range(1, min(places - i, len(self.weights)) + 1)]
            inside = i < self.lengths
            beta[inside, i] = _log_sum(ways)[inside]
        found = np.zeros(size)
        for k, (ids, weights) in enumerate(zip(self.ids, self.weights), 1):
            share = counts[:, None] * np.exp(alpha[:, : places - k + 1] + weights[:, : places - k + 1] + beta[:, k:] - total[:, None])
            own = ids[:, : places - k + 1]
            used = own >= 0
            found += np.bincount(own[used], share[used], size)
            if k == 1 and self.spelled:
                at = self.fallback[:, : places - k + 1]
                for c, s in zip(self.codes[:, : places - k + 1][at].tolist(), share[at].tolist()):
                    np.add.at(found, self.spelled[c], s)
        return found


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    if len(terms) == 1:
        return terms[0]
    stacked = np.stack(terms)
    most = stacked.max(0)
    safe = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(stacked - safe).sum(0)) + safe


class LongWord:
    """One word of many places: its arcs are listed once, and places are walked one by one, each by its own few arcs."""

    def __init__(self, vocabulary: Vocabulary, codes: np.ndarray, lengths: np.ndarray, logp: np.ndarray):
        whole = Lattice(vocabulary, codes, lengths, logp)
        self.n, self.spelled, self.codes, self.fallback = int(lengths[0]), whole.spelled, codes[0], whole.fallback[0]
        starts, ends, weights, ids = [], [], [], []
        for k, (own, w) in enumerate(zip(whole.ids, whole.weights), 1):
            at = np.flatnonzero(np.isfinite(w[0]))
            starts.append(at)
            ends.append(at + k)
            weights.append(w[0][at])
            ids.append(own[0][at])
        self.starts, self.ends, self.weights, self.ids = (np.concatenate(x) for x in (starts, ends, weights, ids))

    def _walk(self, at: np.ndarray, other: np.ndarray, places: range, first: int) -> list[float]:
        """Log sums over the arcs that reach each place (``at``) from ``other``."""
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(self.n + 2)).tolist()
        source, weight = other[order].tolist(), self.weights[order].tolist()
        out = [-math.inf] * (self.n + 1)
        out[first] = 0.0
        for j in places:
            terms = [out[source[i]] + weight[i] for i in range(bounds[j], bounds[j + 1])]
            most = max(terms, default=-math.inf)
            if most > -math.inf:
                out[j] = most + math.log(sum(math.exp(t - most) for t in terms))
        return out

    def total(self) -> float:
        return self._walk(self.ends, self.starts, range(1, self.n + 1), 0)[-1]

    def expected(self, count: float, size: int) -> np.ndarray:
        alpha = np.array(self._walk(self.ends, self.starts, range(1, self.n + 1), 0))
        beta = np.array(self._walk(self.starts, self.ends, range(self.n - 1, -1, -1), self.n))
        share = count * np.exp(alpha[self.starts] + self.weights + beta[self.ends] - alpha[-1])
        used = self.ids >= 0
        found = np.bincount(self.ids[used], share[used], size)
        for c, s in zip(self.codes[self.starts[~used]].tolist(), share[~used].tolist()):
            np.add.at(found, self.spelled[c], s)
        return found


def log_probabilities(words: list[str], vocabulary: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations."""
    out = np.zeros(len(words))
    for own, codes, lengths in batches(words):
        if len(own) == 1 and lengths[0] > LONG:
            out[own] = LongWord(vocabulary, codes, lengths, logp).total()
        else:
            lattice = Lattice(vocabulary, codes, lengths, logp)
            out[own] = lattice.total(lattice.forward())
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, logp: np.ndarray) -> np.ndarray:
    found = np.zeros(len(vocabulary.pieces))
    for own, codes, lengths in batches(words):
        if len(own) == 1 and lengths[0] > LONG:
            found += LongWord(vocabulary, codes, lengths, logp).expected(float(counts[own[0]]), len(found))
        else:
            found += Lattice(vocabulary, codes, lengths, logp).expected(counts[own], len(found))
    return found
