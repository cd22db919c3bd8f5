"""Class-conditional Kneser-Ney models over the characters of running text, in numpy.

A text is its words in lower case, each behind one boundary mark; the marks are symbols like the characters, so what a
character is drawn after reaches over word boundaries. Two classes have models of their own from order
``ORDER`` down to ``SHARED + 1``; below, both back off to one model of all texts, so that what is
rare in both weighs the same. ``ratios`` gives log P(symbol | first class) - log P(symbol | second class) of each gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

ORDER = 6
SHARED = 2
DISCOUNT = 0.75
BITS = 10
OTHER = 1
#: Characters that have a number of their own; the others count as one.
CHARACTERS = (1 << BITS) - 2
#: Characters of text handled at a time; a longer text is read in stretches, cut behind a space where there is one.
STRETCH = 1 << 20


@cache
def word_characters() -> np.ndarray:
    """Whether each code point is a letter, a digit or an underscore."""
    found = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    found[ord("_")] = True
    return found


def stretches(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in lower case, ``STRETCH`` characters or so at a time, with the place of the text that each part is from."""
    places: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        text, start = (text or "").lower(), 0
        while start < len(text):
            end = start + STRETCH
            if end < len(text):
                end = text.rfind(" ", start, end) + 1 or end
            part, start = text[start:end], end
            if size and size + len(part) > STRETCH:
                yield places, parts
                places, parts, size = [], [], 0
            places.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield places, parts


def codes(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")


class Alphabet:
    """Numbers of the characters, the most frequent ones of some texts first; 0 is whatever is no part of a word."""

    def __init__(self, texts: list[str | None]):
        seen = np.zeros(0x110000, np.int64)
        for _, parts in stretches(texts):
            seen += np.bincount(codes(parts), minlength=0x110000)
        seen[~word_characters()] = 0
        top = np.argsort(-seen, kind="stable")[: CHARACTERS - OTHER]
        top = top[seen[top] > 0]
        self.numbers = np.where(word_characters(), OTHER, 0).astype(np.int16)
        self.numbers[top] = OTHER + 1 + np.arange(len(top))

    def grams(self, parts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed grams of the full order, one for each character of a word and the mark behind it; whether it is that mark; its part.

        Parts don't see one another: each stands behind ``order - 1`` marks.
        """
        sizes = np.array([len(p) for p in parts], np.int64)
        own, part = self.numbers[codes(parts)], np.repeat(np.arange(len(parts)), sizes)
        before = np.concatenate([own[:0], [0], own[:-1]])[: len(own)]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        keep = (own != 0) | (before != 0)  # one mark for whatever is between two words
        own, part = own[keep], part[keep]
        n = np.bincount(part, minlength=len(parts))
        row = n + order  # order - 1 marks before, one behind
        starts = np.cumsum(row) - row
        flat = np.zeros(int(row.sum()), np.int64)
        flat[np.repeat(starts + order - 1 - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        packed = np.zeros(len(flat), np.int64)
        for k in range(order):
            packed[order - 1 :] |= flat[order - 1 - k : len(flat) - k] << BITS * k
        ends = (flat == 0) & (np.concatenate([[0], flat[:-1]]) != 0)
        use = ends | (flat != 0)
        return packed[use], ends[use], np.repeat(np.arange(len(parts)), row)[use]

    def counts(self, texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        """The different grams of the texts, ascending, and how often each occurs."""
        found = np.zeros(0, np.int64), np.zeros(0)
        for _, parts in stretches(texts):
            grams = self.grams(parts, order)[0]
            found = _sums(np.concatenate([found[0], grams]), np.concatenate([found[1], np.ones(len(grams))]))
        return found


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights, len(found))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in a sorted table and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """One order: sorted grams with log ratios, sorted contexts with log ratios of what is left for the lower order."""

    def __init__(self, grams: np.ndarray, gram_ratio: np.ndarray, contexts: np.ndarray, context_ratio: np.ndarray):
        self.grams, self.gram_ratio, self.contexts, self.context_ratio = grams, gram_ratio, contexts, context_ratio


class Model:
    def __init__(self, first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], order: int = ORDER, shared: int = SHARED):
        """``first`` and ``second``: the grams of the full order and their counts in the two classes."""
        self.order, self.shared = order, shared
        self.levels: dict[int, Level] = {}
        counts = []
        for own in (first, second):
            by = {order: own}
            for n in range(order - 1, shared, -1):  # different symbols before a gram, in place of its count
                above = by[n + 1][0]
                by[n] = _sums(above & self._mask(n), np.ones(len(above)))
            counts.append(by)
        for n in range(shared + 1, order + 1):
            self._level(n, [c[n] for c in counts])

    def _mask(self, n: int) -> int:
        return (1 << BITS * n) - 1

    def _level(self, n: int, counts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Interpolated probabilities of the seen grams in both classes, as ratios; ``self.levels`` has the orders below."""
        grams = np.union1d(counts[0][0], counts[1][0])
        contexts = np.unique(grams >> BITS)
        lower = self.probabilities(grams & self._mask(n - 1), n - 1)
        logs, rests = [], []
        for k, (own, c) in enumerate(counts):
            total, kinds = np.zeros(len(contexts)), np.zeros(len(contexts))
            at = np.searchsorted(contexts, own >> BITS)
            np.add.at(total, at, c)
            np.add.at(kinds, at, 1)
            rest = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            rest = np.minimum(rest, 1.0)
            mine = np.zeros(len(grams))
            mine[np.searchsorted(grams, own)] = c
            where = np.searchsorted(contexts, grams >> BITS)
            p = np.maximum(mine - DISCOUNT, 0) / np.maximum(total[where], 1e-9) + rest[where] * lower[k]
            logs.append(np.log(p))
            rests.append(np.log(rest))
        self.levels[n] = Level(grams, logs[0] - logs[1], contexts, rests[0] - rests[1])
        self._last = (n, grams, np.stack(logs), contexts, np.stack(rests))

    def probabilities(self, grams: np.ndarray, n: int) -> np.ndarray:
        """(2, grams) probabilities at order ``n``, the one last built, or the shared model's."""
        if n == self.shared:
            return np.tile(self._shared(grams), (2, 1))
        _, known, logs, contexts, rests = self._last
        at, there = _find(known, grams)
        return np.exp(logs[:, at]) * there + ~there  # a gram seen at order n + 1 is seen at order n in one class at least

    def _shared(self, grams: np.ndarray) -> np.ndarray:
        """Add-one smoothed probabilities of the shared order: in how many kinds of longer grams of either class each is."""
        contexts, at, total = np.unique(grams >> BITS, return_inverse=True, return_counts=True)
        own, where, n = np.unique(grams, return_inverse=True, return_counts=True)
        return (n[where] + 1) / (total[at] + CHARACTERS)

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Log ratios of packed grams of the full order; each different gram is looked up once."""
        different, at = np.unique(keys, return_inverse=True)
        value, open_ = np.zeros(len(different)), np.arange(len(different))
        for n in range(self.order, self.shared, -1):
            level = self.levels[n]
            own = different[open_] & self._mask(n)
            place, there = _find(level.grams, own)
            value[open_[there]] += level.gram_ratio[place[there]]
            open_, own = open_[~there], own[~there]
            place, there = _find(level.contexts, own >> BITS)
            value[open_[there]] += level.context_ratio[place[there]]
        return value[at]


def combined(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several groups of texts, added up."""
    return _sums(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
