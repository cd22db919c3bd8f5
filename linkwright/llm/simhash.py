"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits, and two that differ in at most ``distance`` of them link. The bits are cut into
sections; of several sections, one at least has no more than ``distance // sections`` of the differing
bits. In each section the anchors are the words of a covering code: a Hamming code, which covers all words
within radius 1, beside bits that are left as they are. Each fingerprint is at home at its nearest
anchor and visits every anchor within covering radius plus threshold; at each anchor those at home are
compared with the visitors. A link is never missed: if x and y differ in t bits of a section at most, x's
home is within radius 1 of x and so within 1 + t of y. Which error patterns lead from a word to an anchor
depends on the word's syndrome alone, so anchors are listed by one lookup, in the JVM.

More sections mean fewer anchors for each visitor but fuller ones; two sections of 32 bits serve
beyond ``FEW`` different fingerprints. Either way every link is found.

Nulls: a null text is an empty one; documents without words have fingerprint zero and link like any others.
Equal fingerprints are compared once, however many documents share them. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkwright.llm.common import drop_table, give_back, materialise, ready, spread, table
from linkwright.llm.graph import connected_components, ranked_components

SEED = 42
WORDS = 4
DISTANCE = 4
#: Different fingerprints up to which three sections make fewer comparisons and copies than two.
FEW = 4_000_000
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16
#: ``keep_one``: words of a shingle and similarity of shingle sets.
SET_WORDS, SIMILARITY = 5, 0.8
#: One of so many documents in which shingles are counted, and most of the counted ones; both decide the cost alone, never what is found.
SHARE, MOST_COMMON = 4, 1 << 20


def shingle_hashes(text: str | None, words: int = WORDS) -> list[int]:
    """XXH64 of every run of ``words`` words, A-Z lower-cased and joined by spaces; of the whole if there are fewer."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, at, ends = b" ".join(own), 0, [0]
    for w in own:
        at += len(w) + 1
        ends.append(at)
    if len(own) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)] if own else []
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[words:])]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.array(hashes[i : i + BLOCK], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_set(text: str | None, words: int = SET_WORDS) -> set[bytes]:
    """The different shingles, as text."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, text_hash): the fingerprint as a signed long, and a hash that tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    return spread(docs.select("doc_id", "text", text_hash().alias("text_hash"))).mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


class Section:
    """``width`` bits from ``shift``: a Hamming code of length 2**checks - 1 on the lower ones, the others as they are."""

    def __init__(self, shift: int, width: int, checks: int, threshold: int):
        self.shift, self.width, self.checks, self.threshold = shift, width, checks, threshold
        self.coded = (1 << checks) - 1
        if self.coded > width:
            raise ValueError("the code is longer than the section")

    def syndrome_of(self, word: int) -> int:
        return sum(((word & self._mask(j)).bit_count() & 1) << j for j in range(self.checks))

    def _mask(self, j: int) -> int:
        return sum(1 << i for i in range(self.coded) if (i + 1) >> j & 1)

    def patterns(self) -> list[list[int]]:
        """By syndrome, the differences between a word and the anchors that it visits."""
        out: list[list[int]] = [[] for _ in range(1 << self.checks)]
        for free in range(self.threshold + 1):
            for n in range(1 + self.threshold - free + 1):
                for rest in combinations(range(self.coded, self.width), free):
                    for errors in combinations(range(self.coded), n):
                        e = sum(1 << i for i in rest + errors)
                        out[self.syndrome_of(e)].append(e)
        return out

    def _syndrome(self, word: Column) -> Column:
        bits = [F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(self._mask(j)))).bitwiseAND(F.lit(1)), j) for j in range(self.checks)]
        return sum(bits[1:], bits[0]).cast("int")

    def _word(self, fp: Column) -> Column:
        return F.shiftrightunsigned(fp, self.shift).bitwiseAND(F.lit((1 << self.width) - 1))

    def _key(self, anchor: Column) -> Column:
        return anchor.bitwiseOR(F.lit((self.shift + 1) << 40))

    def home(self, fp: Column) -> Column:
        word = self._word(fp)
        s = self._syndrome(word)
        return self._key(word.bitwiseXOR(F.when(s > 0, F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)).otherwise(F.lit(0).cast("long"))))

    def visits(self, fp: Column) -> Column:
        word = self._word(fp)
        table_ = F.array(*[F.array(*[F.lit(e).cast("long") for e in p]) for p in self.patterns()])
        return F.transform(F.element_at(table_, self._syndrome(word) + 1), lambda e: self._key(word.bitwiseXOR(e)))


def sections(n: int, distance: int = DISTANCE) -> list[Section]:
    """``n`` sections of the 64 bits: two or three."""
    widths = {2: [32, 32], 3: [22, 21, 21]}[n]
    return [Section(sum(widths[:i]), w, {2: 5, 3: 4}[n], distance // n) for i, w in enumerate(widths)]


def anchor_pairs(rows: DataFrame, word: str, carried: list[str], near: Column, parts: list[Section]) -> DataFrame:
    """Pairs of rows that meet at an anchor of one of the sections of ``word`` and are ``near``.

    ``carried`` columns come as a_<name> from the row at home and as b_<name> from the visitor.
    """
    side = lambda k: [F.col(c).alias(f"{k}_{c}") for c in carried]
    homes = rows.select(*side("a"), F.explode(F.array(*[s.home(F.col(word)) for s in parts])).alias("home"))
    visitors = rows.select(*side("b"), F.explode(F.concat(*[s.visits(F.col(word)) for s in parts])).alias("visited"))
    return visitors.join(homes.hint("merge"), (F.col("home") == F.col("visited")) & near)  # sizes of exploded tables are underestimated: no broadcast


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, n_sections: int = 3) -> DataFrame:
    """``fps(fp)``, all different -> (a, b), a < b: those that differ in ``distance`` bits or fewer."""
    near = (F.col("a_fp") < F.col("b_fp")) & (differing("a_fp", "b_fp") <= distance)
    met = anchor_pairs(fps, "fp", ["fp"], near, sections(n_sections, distance))
    return met.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).distinct()


def joining_links(fps: DataFrame, distance: int = DISTANCE, n_sections: int = 3) -> DataFrame:
    """``fps(fp)``, all different -> (a, b): links that join all that any links join, without all pairs of a family of fingerprints.

    At each anchor the visitors are first compared with the smallest fingerprint at home there alone, and each keeps one link. Then
    all that meet are compared but for those of one component, and of what is near only a spanning forest is returned (``forest``).
    """
    parts = sections(n_sections, distance)
    homes = lambda df, *more: df.select(F.col("fp").alias("a"), *more, F.explode(F.array(*[s.home(F.col("fp")) for s in parts])).alias("anchor"))
    visits = lambda df, *more: df.select(F.col("fp").alias("b"), *more, F.explode(F.concat(*[s.visits(F.col("fp")) for s in parts])).alias("anchor_"))
    near = (F.col("anchor") == F.col("anchor_")) & (differing("a", "b") <= distance)
    hubs = homes(fps).groupBy("anchor").agg(F.min("a").alias("a"))
    # Hints: Spark takes an exploded table to be as small as the one before, and would send millions of rows through the driver.
    star = visits(fps).join(hubs.hint("merge"), near & (F.col("a") != F.col("b"))).groupBy("b").agg(F.min("a").alias("a"))
    star = materialise(star.select("a", "b"), "simhash-star")
    root = connected_components(star).select(F.col("node").alias("fp"), "root")
    rooted = materialise(fps.join(root, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    hosts = homes(rooted, F.col("root").alias("ra"))
    # A visitor comes once for each anchor, however many it is near there.
    guests = visits(rooted, F.col("root").alias("rb")).join(hosts.hint("merge"), near & (F.col("ra") != F.col("rb")), "left_semi")
    met = guests.select(F.col("anchor_").alias("anchor"), F.col("rb").alias("root"), F.col("b").alias("fp"), F.lit(False).alias("home"))
    return star.unionByName(forest(met.unionByName(hosts.select("anchor", F.col("ra").alias("root"), F.col("a").alias("fp"), F.lit(True).alias("home"))), distance))


def forest(met: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), near each other, of ``met(anchor, root, fp, home)``: links that join all roots which near ones at an anchor join.

    Of those that meet at an anchor one at least is at home. A task keeps a link only if it joins what its links so far don't, so its
    links are fewer than the roots that it has seen, however many near pairs a family of fingerprints has; of the tasks' links between
    two roots one stays. Rows are in total order, so a task that runs again finds the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}
        for anchor, root, fp, home in whole_runs(batches):
            for own in spanning(anchor, root, fp, home, joined, distance):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in own], names=["ra", "rb", "a", "b"])

    dealt = met.repartition("anchor").sortWithinPartitions("anchor", "root", "fp", "home")
    found = dealt.mapInArrow(run, "ra long, rb long, a long, b long")
    return found.groupBy("ra", "rb").agg(F.min(F.struct("a", "b")).alias("link")).select("link.a", "link.b")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of batches that are sorted by the first of them, cut only where its value changes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(own[0], own[0][-1]))
        if held and (cut or held[-1][0][-1] != own[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in own])]
            held = []
        elif cut:
            yield [c[:cut] for c in own]
        held.append([c[cut:].copy() for c in own])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def spanning(anchor: np.ndarray, root: np.ndarray, fp: np.ndarray, home: np.ndarray, joined: dict[int, int], distance: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Links (root of a, root of b, a, b; the smaller root first) of whole anchors; ``joined``, roots by root, learns what they join."""

    def top(r: int) -> int:
        while (up := joined.get(r, r)) != r:
            joined[r] = joined.get(up, up)
            r = up
        return r

    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    hosts = np.flatnonzero(home & mixed[group])
    ends = np.cumsum(sizes[group[hosts]])
    low = 0
    while low < len(hosts):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        own = hosts[low:high]
        low, n = high, sizes[group[own]]
        x = np.repeat(own, n)
        y = np.arange(n.sum()) + np.repeat(starts[group[own]] - np.cumsum(n) + n, n)
        near = np.flatnonzero((root[x] != root[y]) & (np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= distance))
        kept = []
        for i, j in zip(x[near].tolist(), y[near].tolist()):
            r, s = top(int(root[i])), top(int(root[j]))
            if r != s:
                joined[max(r, s)] = min(r, s)
                kept.append((i, j) if root[i] < root[j] else (j, i))
        if kept:
            a, b = np.array(kept).T
            yield root[a], root[b], fp[a], fp[b]


def components_of(prints: DataFrame, distance: int = DISTANCE, n_sections: int | None = None) -> DataFrame:
    """Adds component_id to rows with ``doc_id`` and ``fp``."""
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    links = joining_links(classes.select("fp"), distance, n_sections or (3 if classes.count() <= FEW else 2))
    linked = materialise(ranked_components(links, classes, "fp", "first_id"), "simhash-components").select("fp", F.lit(True).alias("linked"), "component_id")
    named = classes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    return prints.join(named, "fp")


def simhash_components(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, n_sections: int | None = None) -> DataFrame:
    """(doc_id, fp, text_hash, component_id) for every row of ``docs(doc_id, text)``; component_id is the smallest doc_id reachable."""
    ready(docs.sparkSession)
    prints = materialise(fingerprints(docs, words), "simhash-prints")
    return components_of(prints, distance, n_sections).select("doc_id", "fp", "text_hash", "component_id")


def prefix_length(n: int, similarity: float) -> int:
    """How many of ``n`` ordered shingles hold one that every set of that similarity shares among its own first ones."""
    return min(n, n - math.ceil(similarity * n - 1e-9) + 1)


def set_hashes(text: str | None, words: int = SET_WORDS) -> np.ndarray:
    """The hashes of the different shingles, ascending, as signed longs."""
    return np.unique(np.array(shingle_hashes(text, words), np.uint64).view(np.int64))


def _lists(own: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))


def with_sets(texts: DataFrame, words: int = SET_WORDS) -> DataFrame:
    """``texts(key, text)`` -> (key, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([set_hashes(t.as_py(), words) for t in batch.column(1)])], names=["key", "shingles"])

    return texts.mapInArrow(run, "key long, shingles array<long>")


def common_shingles(docs: DataFrame, words: int = SET_WORDS, share: int = SHARE, most: int = MOST_COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that many documents share: at most ``most``, those with the highest counts.

    They are counted in one of ``share`` documents, a fixed part of them however many there are, so that what goes
    unnoticed is held by a few dozen documents at every size.
    """
    asked = docs.select(text_hash().alias("key"), "text").where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0)
    counts = materialise(with_sets(asked, words).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where("n > 2"), "simhash-common")
    least, known = 3, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect():  # ten thousand rows at most
        known += r.k
        if known > most:
            least = r.n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    own, n = found["s"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(own)
    return own[order], n[order]


def shingle_prefixes(docs: DataFrame, similarity: float = SIMILARITY, words: int = SET_WORDS) -> DataFrame:
    """(doc_id, text_hash, fp, nid, n, weight, prefix): the fingerprint, a key of the document's set of shingles, its size, how common they are, and its first shingles, rare ones first.

    The order is that of the counts, then of the hashes. Any order that is the same for all finds every pair; this
    one keeps shingles that many documents share out of the prefixes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64)
            sets = [set_hashes(t, words) for t in texts]
            nids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            first, weights = [], []
            for x in sets:
                often = np.zeros(len(x), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    often = np.where(known[at] == x, counts[at], 0)
                weights.append(often.sum() / max(1, len(x)))
                first.append(x[np.argsort(often, kind="stable")[: prefix_length(len(x), similarity)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints), pa.array(nids), pa.array([len(x) for x in sets], pa.int32()), pa.array(weights, pa.float32()), _lists(first)], names=["doc_id", "text_hash", "fp", "nid", "n", "weight", "prefix"])

    return spread(docs.select("doc_id", "text", text_hash().alias("text_hash"))).mapInArrow(run, "doc_id long, text_hash long, fp long, nid long, n int, weight float, prefix array<long>")


def could_be(similarity: float, a: str, b: str) -> Column:
    """Whether sets can be that similar by their sizes and the places in them of a shingle that both hold."""
    least = similarity / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-9  # shingles that similar sets share
    return F.least(f"{a}.left", f"{b}.left") >= least


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """(s, own, root, hub, hub_root) of ``nodes(nid, n, weight, prefix, root)`` for prefix shingles that sets of different components hold.

    ``own`` and ``hub`` are (weight, nid, n, left): a holder, and the one with the most common shingles; ``left`` counts the shingles
    from this one on. A text that others were made from by changes has nothing of its own, so it is the hub among them.
    """
    one = F.struct("weight", "nid", "n", (F.col("n") - F.col("at")).alias("left"))
    tokens = nodes.select("nid", "n", "weight", "root", F.posexplode("prefix").alias("at", "s")).select("s", one.alias("own"), "root")
    top = F.max(F.struct("own", "root")).alias("top")
    groups = tokens.groupBy("s").agg(top, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s", F.col("top.own").alias("hub"), F.col("top.root").alias("hub_root"))
    return materialise(tokens.join(groups, "s"), "simhash-shared")


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts, ``texts(nid, text)``, have similar sets of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.int64)
        for batch in batches:
            ids, others, keep = batch.column(0).to_pylist(), batch.column(1), []
            for i, (a, text, other) in enumerate(zip(ids, batch.column(2), batch.column(3))):
                if a != last:
                    last, own = a, set_hashes(text.as_py(), words)
                its = set_hashes(other.as_py(), words)
                both = len(np.intersect1d(own, its, assume_unique=True))
                if both >= similarity * (len(own) + len(its) - both) - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), others.take(pa.array(keep, pa.int32()))], names=["a", "b"])

    side = lambda k: texts.select(F.col("nid").alias(k), F.col("text").alias(f"t_{k}"))
    met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")  # sorted by a: its set is made once a run
    return materialise(met.mapInArrow(run, "a long, b long"), "simhash-similar")


def texts_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(nid, text), one row for each end of ``pairs``."""
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    wanted = materialise(ends.join(nodes, "nid").select("nid", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")), "simhash-wanted")  # of known size: broadcast where small
    rows = docs.select("doc_id", "text").join(wanted, (text_hash() == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return materialise(rows.select("nid", "text").dropDuplicates(["nid"]), "simhash-texts")  # so that a join by one hub can be split


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of ``nodes(nid, fp)``: pairs whose links by fingerprints (``joining_links``) join all that are joined by any."""
    classes = materialise(nodes.groupBy("fp").agg(F.min("nid").alias("first")), "simhash-prints")
    links = joining_links(classes.select("fp"), DISTANCE, 3 if classes.count() <= FEW else 2)
    side = lambda k: classes.select(F.col("fp").alias(f"{k}_fp"), F.col("first").alias(k))
    linked = links.select(F.col("a").alias("a_fp"), F.col("b").alias("b_fp")).join(side("a"), "a_fp").join(side("b"), "b_fp").select("a", "b")
    equal = nodes.select("nid", "fp").join(classes, "fp").where("nid <> first").select(F.col("first").alias("a"), F.col("nid").alias("b"))
    return materialise(linked.unionByName(equal), "simhash-close")


def stars(links: DataFrame) -> DataFrame:
    """``links(a, b)`` as one link from the root of each component to each of its other nodes."""
    return connected_components(links).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def with_roots(rows: DataFrame, star: DataFrame) -> DataFrame:
    """Adds the root of ``nid`` by ``stars``, itself where it has none."""
    return rows.join(star.select(F.col("b").alias("nid"), F.col("a").alias("_root")), "nid", "left").withColumn("root", F.coalesce("_root", "nid")).drop("_root")


def similar_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, words: int = SET_WORDS) -> DataFrame:
    """(a, b) of ``nodes(nid, doc_id, text_hash, fp, n, weight, prefix)``: links that join all sets that are joined by any similar ones, and no others.

    First texts with close fingerprints are found by anchors and compared. What fingerprints don't tell is found by shared
    shingles, among texts of different components: two similar sets share one of their prefixes. Each holder of a shingle is
    compared with the group's hub alone, which joins most of a group of copies by one comparison for each. Then holders that are
    still in different components are compared, all of them; pairs inside a component have nothing to add, so of what is known by
    then only stars are carried on.
    """
    close = close_pairs(nodes)
    links = stars(confirmed(close, texts_of(docs, nodes, close), similarity, words))
    shared = shared_shingles(with_roots(nodes, links))
    unordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first = shared.where((F.col("root") != F.col("hub_root")) & could_be(similarity, "own", "hub")).select(F.col("hub.nid").alias("a"), F.col("own.nid").alias("b"))
    first = materialise(first.distinct(), "simhash-first")
    links = stars(links.unionByName(confirmed(first, texts_of(docs, nodes, first), similarity, words)))

    rooted = materialise(with_roots(shared.select("s", "own", F.col("own.nid").alias("nid")), links).select("s", "own", "root"), "simhash-rooted")
    drop_table(shared)
    open_ = rooted.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s")
    held = rooted.join(open_, "s")
    side = lambda k: held.select("s", F.col("own").alias(k), F.col("root").alias(f"root_{k}"))
    met = side("x").join(side("y"), "s").where((F.col("root_x") < F.col("root_y")) & could_be(similarity, "x", "y"))
    rest = met.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    rest = materialise(rest.join(unordered(close.unionByName(first)), ["a", "b"], "left_anti"), "simhash-rest")
    return links.unionByName(confirmed(rest, texts_of(docs, nodes, rest), similarity, words))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = SET_WORDS) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; of rows equal in id and text, one stays.

    A group are those that share ``similarity`` of their different five-word shingles, also through others. Close fingerprints
    are looked for first, but one alone removes nothing: with repeats in it, it may stand for quite another text, so the
    comparison has to confirm it. Rows of one id with
    different texts are documents of their own: of two that are similar the one with the smaller text hash stays.
    """
    ready(docs.sparkSession)
    give_back()  # what fits before this stage have left
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    prints = shingle_prefixes(docs, similarity, words)
    nodes = materialise(prints.groupBy("nid").agg(least, F.min("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("weight").alias("weight"), F.any_value("prefix").alias("prefix")).select("nid", "first.doc_id", "first.text_hash", "fp", "n", "weight", "prefix"), "simhash-nodes")
    linked = ranked_components(similar_links(docs, nodes, similarity, words), nodes.select("nid", "doc_id"), "nid", "doc_id")
    gone = linked.where(F.col("nid") != F.col("root_key")).select("nid")
    kept = materialise(nodes.join(gone, "nid", "left_anti").select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")), "simhash-kept")
    same = (text_hash() == F.col("__kept_hash")) & F.col("doc_id").eqNullSafe(F.col("__kept_id"))
    keys = docs.select("doc_id", text_hash().alias("__kept_hash")).groupBy("doc_id", "__kept_hash").agg(F.count("*").alias("rows"))
    repeated = materialise(keys.where("rows > 1").select(F.col("doc_id").alias("__kept_id"), "__kept_hash"), "simhash-repeated")
    stay = docs.join(kept, same, "left_semi")
    once = stay.join(repeated, same, "left_semi").withColumn("__text_hash", text_hash()).dropDuplicates(["doc_id", "__text_hash"]).drop("__text_hash")
    return stay.join(repeated, same, "left_anti").unionByName(once)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op6_simhash_anchor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
