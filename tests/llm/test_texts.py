"""Packing, sharding, SimHash, media, WARC, language model, pieces: against brute force and on odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkwright.llm import common, graph, jpeg, lattice, lm, packing, pieces, sharding, simhash, warc


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_scratch_can_be_dropped(spark):
    kept = common.materialise(spark.range(5), "test")
    assert kept.count() == 5 and all(common.scratch_folder(spark) in f.replace("file:///", "file:/").replace("file:/", "file:///") for f in kept.inputFiles())
    common.drop_table(kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(kept.inputFiles()[0]).count()


# --- packing ---------------------------------------------------------------------------------------------------


def check_packed(found, texts, capacity):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc_id, text in texts:
        ids = np.array(encoder.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % capacity or min(capacity, len(ids))
        for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
            end = first if start == 0 else start + capacity
            expected[doc_id, piece, start, end - start, zlib.crc32(ids[start:end].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r["length"] for r in found)


def test_packing_on_odd_rows(docs, no_docs):
    for capacity in (64, 1024):
        n, total = check_packed(rows(packing.pack_documents(docs, capacity)), [(r.doc_id, r.text) for r in docs.collect()], capacity)
        assert n <= math.ceil(total / capacity) + 1
    assert rows(packing.pack_documents(no_docs)) == []


def test_long_white_space_is_encoded():
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * 1_000_000, "a" + "\n" * 1_200_000 + "b", "x" * 300_000, " " * 2_000_000 + "<|endoftext|>", "a<|endoftext|>b", "<|endoftext|>", "< |endoftext|> <|endoftext|"):
        assert packing.token_ids(text, packing.byte_bpe()).tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


def test_packing_keeps_ids(docs):
    found = packing.pack_documents(docs.where("doc_id = 10"), with_ids=True).first()
    assert found.ids[-1] == 2 and len(found.ids) == found.length


def test_packing_query_is_tight(spark, sf):
    texts = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    n, total = check_packed(rows(packing.op10_best_fit_packing(spark, sf)), texts, 1024)
    assert n <= 1.01 * math.ceil(total / 1024) + 1


def test_plan_places_each_rank_once():
    rng = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 101), 40, replace=False), rng.integers(1, 500, 40))}
    used, ranks = defaultdict(int), Counter()
    for size, lo, hi, first, offset in packing.plan(counts, 100):
        for i in range(lo, hi):
            assert used[first + i - lo] == offset
            used[first + i - lo] += size
            ranks[size, i] += 1
    assert max(used.values()) <= 100 and set(ranks.values()) == {1} and len(ranks) == sum(counts.values())


@pytest.mark.parametrize("seed,low,high", [(0, 1, 101), (1, 1, 12), (2, 20, 45), (3, 50, 101)])
def test_plan_equals_best_fit_on_single_pieces(seed, low, high):
    """Decreasing best fit piece by piece: the same number of sequences and the same gaps left."""
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(low, high, 700).tolist(), reverse=True)
    gaps = []
    for size in sizes:
        fitting = [g for g in gaps if g >= size]
        if fitting:
            gaps.remove(min(fitting))
            gaps.append(min(fitting) - size)
        else:
            gaps.append(100 - size)
    used = defaultdict(int)
    for size, lo, hi, first, _ in packing.plan(dict(Counter(sizes)), 100):
        for i in range(hi - lo):
            used[first + i] += size
    assert sorted(100 - x for x in used.values()) == sorted(gaps)


def test_long_plans_are_joined(docs, monkeypatch):
    monkeypatch.setattr(packing, "MOST_STEPS", 0)
    check_packed(rows(packing.pack_documents(docs, 64)), [(r.doc_id, r.text) for r in docs.collect()], 64)


# --- sharding --------------------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    full = sharding.lookup_table(names, 1009)
    share = Counter(full)
    assert set(share) == set(range(10)) and max(share.values()) - min(share.values()) <= 1
    assert sharding.lookup_table(names[::-1], 1009) == [9 - i for i in full]
    less = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less) if a != 9)
    assert moved < 0.2 * 1009
    for bad in (dict(shards=names, slots=1000), dict(shards=[]), dict(shards=["a", "a"])):
        with pytest.raises(ValueError):
            sharding.lookup_table(**bad)


def test_lookup_table_takes_turns():
    names, m = ["a", "b", "c"], 13
    taken = [-1] * m
    order = [[(sharding._hash(n, "offset") % m + k * (sharding._hash(n, "step") % (m - 1) + 1)) % m for k in range(m)] for n in names]
    turn = 0
    while -1 in taken:
        slot = next(s for s in order[turn % 3] if taken[s] < 0)
        taken[slot] = turn % 3
        turn += 1
    assert sharding.lookup_table(names, m) == taken


def test_place_keeps_rows(docs, no_docs, tmp_path):
    placed = sharding.place(docs, F.col("doc_id"), ["a", "b", "c"], 101)
    found = rows(placed)
    assert len(found) == docs.count() and all(r["shard"] in "abc" and 0 <= r["slot"] < 101 for r in found)
    assert len({r["shard"] for r in found if r["doc_id"] == 1}) == 1
    assert sharding.place(no_docs, F.col("doc_id"), ["a"], 7).count() == 0
    sharding.write_shards(docs, F.col("doc_id"), ["a", "b", "c"], str(tmp_path / "s"), 101)
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_sharding_query(spark, sf):
    table = sharding.lookup_table([f"shard-{i:04d}" for i in range(sharding.SHARDS)])
    import xxhash

    for r in rows(sharding.op2_permutation_sharding(spark, sf)):
        assert r["shard"] == f"shard-{table[r['slot']]:04d}"
        signed = int.from_bytes(xxhash.xxh64(struct.pack("<q", r["doc_id"]), 42).digest(), "big", signed=True)
        assert r["slot"] == signed % sharding.SLOTS


# --- SimHash ---------------------------------------------------------------------------------------------------


def brute_components(ids, prints, distance):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint_by_definition():
    import xxhash

    text = "The Quick  brown\tfox jumps over THE lazy dog"
    words = [w.lower() for w in text.split()]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(simhash.shingle_hashes(text)) == expected
    assert simhash.fingerprint(simhash.shingle_hashes("One two")) == xxhash.xxh64_intdigest("one two", 42)
    assert simhash.fingerprint(simhash.shingle_hashes(None)) == simhash.fingerprint(simhash.shingle_hashes(" \n")) == 0


@pytest.mark.parametrize("n_sections", [2, 3])
def test_anchors_miss_no_link(spark, n_sections):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    prints = set(base)
    for x in base:
        for k in range(1, 7):
            y = x
            for b in rng.choice(64, k, replace=False):
                y ^= 1 << int(b)
            prints.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = {(r.a, r.b) for r in simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, n_sections).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    assert found == expected and len(expected) > 200


@pytest.mark.parametrize("n_sections", [2, 3])
def test_joining_links_join_what_links_do(spark, n_sections):
    """Families around one fingerprint, chains of small steps, and strangers; far fewer links than pairs."""
    rng = np.random.default_rng(13)
    flipped = lambda x, k: x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = set(base) | {flipped(base[0], 2) for _ in range(150)}
    for start in base[1:6]:
        x = start
        for _ in range(12):
            x = flipped(x, 3)
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.joining_links(fps, 4, n_sections).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in found)
    expected = brute_components(signed, [x & ((1 << 64) - 1) for x in signed], 4)
    root = {r.node: r.root for r in graph.connected_components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert [root.get(x, x) for x in signed] == expected
    assert len(found) < simhash.fingerprint_links(fps, 4, n_sections).count() / 5


def test_links_of_a_family_grow_with_its_size(spark, monkeypatch):
    """Fingerprints that differ by pairs of sixteen bits, no hub near all: many times as many near pairs as links, stored ones too."""
    monkeypatch.setattr(simhash, "connected_components", lambda links: graph.connected_components(links.limit(0)))  # the stars join nothing
    family = [sum(1 << 4 * i for i in range(16) if m >> i & 1) for m in range(1 << 16) if m.bit_count() == 2]
    signed = [x - (1 << 64) if x >> 63 else x for x in family]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.joining_links(fps).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4 for a, b in found)
    root = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(found, "a long, b long")).collect()}
    assert len(set(root.values())) == 1 and len(root) == len(family)
    assert simhash.fingerprint_links(fps).count() == 120 * 119 // 2 and len(found) < 10 * len(family)


def test_a_task_keeps_a_forest():
    """Groups cut by batches of any size; each link joins what those before it didn't."""
    rng = np.random.default_rng(4)
    bits = [1 << int(b) for b in rng.permutation(64)[:12]]
    met = sorted((a, r, r, bool(h)) for a in range(6) for r, h in {sum(b for b in bits if rng.random() < 0.2): rng.random() < 0.5 for _ in range(40)}.items() if r < 1 << 63)
    near = {(r, s) for a, r, _, h in met for b, s, _, _ in met if a == b and h and r != s and (r ^ s).bit_count() <= 4}
    expected = brute_links({r for _, r, _, _ in met}, near)
    for size in (1, 3, 17, len(met)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*met[i : i + size])], names=["anchor", "root", "fp", "home"]) for i in range(0, len(met), size)]
        joined, links = {}, []
        for own in simhash.whole_runs(iter(batches)):
            for ra, rb, a, b in simhash.spanning(*own, joined, 4):
                assert (ra < rb).all()
                links += zip(a.tolist(), b.tolist())
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        assert brute_links({r for _, r, _, _ in met}, links) == expected and len(links) == len(expected) - len(set(expected.values()))


def brute_links(nodes, links):
    """Smallest node that each reaches."""
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_exploded_anchors_are_not_broadcast(spark):
    """The stored fingerprints are small enough to broadcast; what is exploded from them isn't."""
    fps = common.materialise(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "test")
    for links, key in ((simhash.joining_links(fps), "anchor_"), (simhash.fingerprint_links(fps), "visited")):
        plan = links._jdf.queryExecution().executedPlan().toString()
        assert f"SortMergeJoin [{key}" in plan and f"BroadcastHashJoin [{key}" not in plan


def test_every_word_is_near_its_home():
    for part in simhash.sections(3) + simhash.sections(2):
        assert sum(map(len, part.patterns())) == len({e for p in part.patterns() for e in p})
        assert {part.syndrome_of(1 << i) for i in range(part.coded)} == set(range(1, 1 << part.checks))


def test_simhash_on_odd_rows(docs, no_docs):
    found = rows(simhash.simhash_components(docs))
    assert len(found) == docs.count()
    prints = [r["fp"] % (1 << 64) for r in found]
    assert [r["component_id"] for r in found] == brute_components([r["doc_id"] for r in found], prints, 4)
    assert {r["component_id"] for r in found if r["doc_id"] in (2, 3, 8)} == {2}
    assert rows(simhash.simhash_components(no_docs)) == []


def test_keep_one_of_each_group(docs):
    kept = rows(simhash.keep_one(docs))
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 4, 6, 7, 9, 10, 11, 12, 13]
    assert sum(r["doc_id"] is None for r in kept) == 1 and set(kept[0]) == set(docs.columns)


def test_similar_texts_are_one_group(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
    texts = [(1, " ".join(base))]
    for i in range(2, 14):  # from two words of 300 changed to thirteen
        own = list(base)
        for at in rng.choice(300, i, replace=False):
            own[at] = f"new{i}x{at}"
        texts.append((i, " ".join(own)))
    texts += [(100 + i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))) for i in range(30)] + [(200, "short text"), (201, "short texts"), (202, None)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    sets = {i: simhash.shingle_set(t) for i, t in texts}
    alone = {i for i, _ in texts if all(i == j or len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for j, _ in texts)}
    assert alone - {i for i, _ in texts if i < 14} <= kept and 1 in kept and {200, 201, 202} <= kept
    assert not kept & {2, 3, 4}  # over nine tenths alike


def altered(words, n, rng, tag):
    """``words`` with ``n`` of them, not near one another, replaced."""
    own = list(words)
    for at in rng.choice(np.arange(10, len(words) - 10, 10), n, replace=False):
        own[at] = f"{tag}x{at}"
    return own


def similar(a, b):
    a, b = (simhash.shingle_set(" ".join(own)) for own in (a, b))
    return len(a & b) / len(a | b)


def test_no_pair_at_the_set_similarity_is_missed(spark):
    rng = np.random.default_rng(21)
    texts, pairs = [], []
    for i in range(60):  # six replaced words of 300 change thirty shingles of 296
        base = [f"w{x}" for x in rng.integers(0, 50_000, 300)]
        texts += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(altered(base, 5 + i % 2, rng, f"n{i}")))]
        a, b = (simhash.shingle_set(t) for _, t in texts[-2:])
        pairs.append(len(a & b) / len(a | b))
    assert 0.80 <= min(pairs) and max(pairs) <= 0.85
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(60)}


def test_chain_through_fingerprints_reaches_the_similar(spark):
    """Equal fingerprints of 1 and 2 hide no text that is like 2 alone."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
    bits = lambda own: simhash.fingerprint(simhash.shingle_hashes(" ".join(own)))
    other = next(o for o in (altered(base, 2, rng, f"o{i}") for i in range(2000)) if (bits(o) ^ bits(base)).bit_count() <= 4)
    like = next(o for o in (altered(other, 8, rng, f"l{i}") for i in range(2000)) if (bits(o) ^ bits(base)).bit_count() > 4 and (bits(o) ^ bits(other)).bit_count() > 4 and similar(o, other) >= 0.8 > similar(o, base))
    texts = [(i, " ".join(own)) for i, own in enumerate((base, other, like), 1)]
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()] == [1]


def brute_kept(texts, similarity=0.8):
    """Smallest ids of the groups by all pairs of shingle sets."""
    sets = {i: simhash.shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i for i in sets if find(i) == i}


def test_kept_documents_equal_brute_force(spark):
    """Stars, chains that drift away from their start, passages that many texts share, and texts of a few words."""
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 9000, n)]
    passage, texts = word(60), []
    for _ in range(6):
        own = base = word(120)
        for k in range(12):
            own = altered(own if k % 2 else base, 1 + k % 3, rng, f"c{len(texts)}")
            texts.append(" ".join(own))
    for _ in range(60):
        texts.append(" ".join(word(int(rng.integers(3, 60))) + passage + word(int(rng.integers(3, 60)))))
    texts += [" ".join(word(int(rng.integers(0, 9)))) for _ in range(60)] + texts[:5] + ["", " ", "one", "one"]
    order = rng.permutation(len(texts))
    rows_ = [(int(i), texts[k]) for i, k in enumerate(order)]
    expected = brute_kept(rows_)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows_, "doc_id long, text string").repartition(5)).collect()}
    assert kept == expected and len(expected) < len(rows_) - 40


def test_fingerprints_find_near_duplicates_of_the_pipeline(spark, monkeypatch):
    """Copies with close fingerprints are found by them, with the search by shared shingles taken away; one alone removes nothing."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 600)]
    bits = lambda own: simhash.fingerprint(simhash.shingle_hashes(" ".join(own)))
    near = next(o for o in (altered(base, 2, rng, f"o{i}") for i in range(2000)) if 0 < (bits(o) ^ bits(base)).bit_count() <= 4)
    others = [[f"w{x}" for x in rng.integers(0, 50_000, 100)] for _ in range(5)]
    repeats = [["these", "five", "words", "come", "back"] * 120 + own for own in others[:2]]
    texts = [(i, " ".join(own)) for i, own in enumerate([base, near, *others, *repeats], 1)]
    seen, links, shared = [], simhash.joining_links, simhash.shared_shingles
    monkeypatch.setattr(simhash, "joining_links", lambda fps, *a: seen.append({r.fp % (1 << 64) for r in fps.collect()}) or links(fps, *a))
    monkeypatch.setattr(simhash, "shared_shingles", lambda nodes: shared(nodes.limit(0)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert seen == [{bits(t.split()) for _, t in texts}] and kept == {i for i, _ in texts} - {2}


def test_repeats_remove_no_other_text(spark):
    rng = np.random.default_rng(9)
    phrase = "these five words come back".split()
    texts = []
    for i in range(1, 7):  # 600 of 1,000 words are one phrase
        own = [f"w{x}" for x in rng.integers(0, 50_000, 400)]
        texts.append((i, " ".join(own[:200] + phrase * 120 + own[200:])))
    prints = [simhash.fingerprint(simhash.shingle_hashes(t)) for _, t in texts]
    assert all((p ^ prints[0]).bit_count() <= 4 for p in prints)
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3, 4, 5, 6]


def test_simhash_query(spark, sf):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    found = {r.doc_id: r for r in simhash.op6_simhash_anchor_cover(spark, sf).collect()}
    ids = sorted(texts)
    prints = [simhash.fingerprint(simhash.shingle_hashes(texts[i])) for i in ids]
    assert [found[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [found[i].component_id for i in ids] == brute_components(ids, prints, 4)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300), (None, 5)]
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {299: 299, 300: 299}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- media -----------------------------------------------------------------------------------------------------


class Bits:
    def __init__(self):
        self.text = ""

    def add(self, value, n):
        self.text += f"{value:0{n}b}" if n else ""

    def bytes(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def plain_jpeg(blocks, width, height, sampling, restart=0):
    """A baseline JPEG of given quantised terms by plain loops: ``blocks[mcu]`` is a list of (component, 64 terms)."""
    dc, ac = list(range(12)), sorted({r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)})
    spec = lambda symbols: bytes([0] * 7 + [min(200, len(symbols))] + [max(0, len(symbols) - 200)] + [0] * 7) + bytes(symbols)

    def codes(symbols):
        out, code = {}, 0
        for i, s in enumerate(symbols):
            n = 8 if i < 200 else 9
            code = code << 1 if i == 200 else code
            out[s] = (code, n)
            code += 1
        return out

    tables = codes(dc), codes(ac)
    magnitude = lambda v: abs(v).bit_length()
    raw = lambda v, s: v if v > 0 else v + (1 << s) - 1
    scan, bits, previous = b"", Bits(), defaultdict(int)
    for m, mcu in enumerate(blocks):
        if restart and m and m % restart == 0:
            scan += bits.bytes() + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, previous = Bits(), defaultdict(int)
        for component, terms in mcu:
            v = terms[0] - previous[component]
            previous[component] = terms[0]
            s = magnitude(v)
            bits.add(*tables[0][s])
            bits.add(raw(v, s) if s else 0, s)
            zeros = 0
            last = max((k for k in range(1, 64) if terms[k]), default=0)
            for k in range(1, last + 1):
                if not terms[k]:
                    zeros += 1
                    continue
                while zeros > 15:
                    bits.add(*tables[1][0xF0])
                    zeros -= 16
                s = magnitude(terms[k])
                bits.add(*tables[1][zeros << 4 | s])
                bits.add(raw(terms[k], s), s)
                zeros = 0
            if last < 63:
                bits.add(*tables[1][0])
    scan += bits.bytes()
    n = len(sampling)
    segment = jpeg._segment
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([3] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
        + segment(0xC4, b"\0" + spec(dc) + b"\x10" + spec(ac)) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
        + segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\0\x3f\0") + scan + b"\xff\xd9"
    )


@pytest.mark.parametrize("sampling,restart", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_decoder_reads_any_baseline_image(sampling, restart):
    rng = np.random.default_rng(5)
    width, height = 83, 61
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = (-(-width // 8), -(-height // 8)) if len(sampling) == 1 else (-(-width // (8 * h)), -(-height // (8 * v)))
    units = [0] if len(sampling) == 1 else [i for i, (a, b) in enumerate(sampling) for _ in range(a * b)]
    term = lambda: int(rng.integers(-300, 300)) if rng.random() < 0.3 else 0
    blocks = [[(c, [term() for _ in range(64)]) for c in units] for _ in range(across * down)]
    data = plain_jpeg(blocks, width, height, sampling, restart)
    image = jpeg.parse(data)
    terms = jpeg.coefficients([image, image])[1]
    assert (image.width, image.height) == (width, height)
    assert terms.tolist() == [t for mcu in blocks for _, t in mcu]
    pixels = jpeg.thumbnail(image, terms)
    assert pixels.shape == (-(-height // 8), -(-width // 8))
    assert pixels[0, 0] == np.clip((blocks[0][0][1][0] * 3 + 4 >> 3) + 128, 0, 255)
    if len(sampling) > 1 and h == 2:
        assert pixels[0, 3] == np.clip((blocks[1][1][1][0] * 3 + 4 >> 3) + 128, 0, 255)


def test_payloads_come_back():
    payloads = [jpeg.pad(os.urandom(n)) for n in (0, 1, 63, 64, 65, 4096, 64 * 65, 70_000)] + [b"\xff" * 192, bytes(64)]
    stored = jpeg.encode_payloads(payloads)
    images = [jpeg.parse(m) for m in stored]
    assert [jpeg.payload_of(i, t) for i, t in zip(images, jpeg.coefficients(images))] == payloads
    assert all(len(p) % 64 == 0 and p for p in payloads)


def test_payload_beyond_the_usual_width_comes_back():
    assert jpeg.shape_of(64 * 8191) == (64, 8191) and jpeg.shape_of(8191 * 8191) == (8191, 8191)
    payload = os.urandom(64 * 1000) * 525  # 525,000 blocks
    assert jpeg.shape_of(len(payload) // 64)[0] == 65
    image = jpeg.parse(jpeg.encode_payloads([payload])[0])
    assert image.width == 8 * 65 and jpeg.payload_of(image, jpeg.coefficients([image])[0]) == payload


def test_zigzag_is_the_standard_order():
    assert jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.zigzag()) == list(range(64))


def test_damaged_images_have_an_error(spark):
    good = jpeg.encode_payloads([jpeg.pad(b"abc" * 100)])[0]
    media = spark.createDataFrame([(1, good), (2, None), (3, b"nothing"), (4, good[:-40]), (5, b"")], "id int, media binary")
    found = {r.id: r for r in jpeg.media_features(media, keep=("id",)).collect()}
    assert found[1].error is None and found[1].payload == jpeg.pad(b"abc" * 100) and found[1].width == 40
    assert all(found[i].error and found[i].width is None for i in (2, 3, 4, 5))


def test_media_on_odd_rows(docs, no_docs):
    found = rows(jpeg.media_features(jpeg.media_of_texts(docs), keep=("doc_id", "n_bytes")))
    texts = Counter(jpeg.pad((r.text or "").encode()) for r in docs.collect())
    assert Counter(r["payload"] for r in found) == texts
    assert jpeg.media_features(jpeg.media_of_texts(no_docs)).count() == 0


def test_media_query(spark, sf):
    texts = {r.doc_id: (r.text or "").encode() for r in common.table(spark, sf, "documents").collect()}
    for r in jpeg.op3_jpeg_media_columns(spark, sf).collect():
        p = jpeg.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


# --- WARC ------------------------------------------------------------------------------------------------------


def brute_pages(pages):
    first = {}
    for page_id, html in pages:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = Counter()
    for page_id, html in pages:
        payload, of = (html or "").encode(), first.get(html or "")
        out[page_id, len(payload), warc.base32_sha1(payload), "response" if page_id == of else "revisit", None if page_id == of else of] += 1
    return out


def test_warc_on_odd_rows(spark):
    pages = [(5, "http://a/ b\r\nX: y", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://c", None), (9, "http://d", ""), (7, "http://é", "\r\n\r\nHTTP"), (8, "http://e", "x" * 300_000), (5, "http://a/ b\r\nX: y", "<p>one</p>"), (None, "http://n", "<p>one</p>"), (None, "http://m", "only")]
    df = spark.createDataFrame([(*p, "k", 1, 2) for p in pages], "page_id long, url string, html string, sha1 string, revisit int, file int")
    folder = common.scratch_path(common.ready(spark), "warc-test")
    index = warc.write_archives(df, folder)
    found = warc.read_records(index, folder).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == brute_pages([(p[0], p[2]) for p in pages])
    urls = {r.page_id: r.url for r in found if r.page_id is not None}
    assert urls[3] is None and urls[5] == "http://a/%20b%0D%0AX:%20y" and urls[7] == "http://é"
    assert {r.payload for r in found if r.page_id == 8} == {b"x" * 300_000}
    only = warc.read_records(index.where("page_id = 8"), folder).collect()
    assert len(only) == 1 and only[0].page_id == 8
    spark.createDataFrame([], df.schema)
    none = warc.write_archives(spark.createDataFrame([], df.schema), folder)
    assert warc.read_records(none, folder).count() == 0


def test_small_payloads_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    folder = common.scratch_path(common.ready(spark), "warc-test")
    found = {r.page_id: r.record_type for r in warc.read_records(warc.write_archives(df, folder, min_bytes=4), folder).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_gzip_and_records_are_checked():
    import gzip

    r = warc.build_record(1, "http://a", b"body", warc.base32_sha1(b"body"), None, False)
    member = warc.gzip_member(r)
    assert gzip.decompress(member + member) == r + r
    assert warc.parse_record(member)["payload"] == b"body"
    for broken in (r.replace(b"body", b"bodx"), r[:-3], b"WARX" + r):
        with pytest.raises(ValueError):
            warc.parse_record(warc.gzip_member(broken))


def test_ranges_are_joined():
    assert warc.ranges([(0, 10), (10, 10), (25, 5), (1000, 5), (1005, 1)], gap=5, most=100) == [(0, 30, [0, 1, 2]), (1000, 6, [3, 4])]
    assert warc.ranges([(0, 60), (60, 60)], gap=5, most=100) == [(0, 60, [0]), (60, 60, [1])]


def test_warc_query(spark, sf):
    pages = [(r.page_id, r.html) for r in common.table(spark, sf, "pages").collect()]
    found = Counter(tuple(r) for r in warc.op7_warc_index_first(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert found == brute_pages(pages)


# --- language model ---------------------------------------------------------------------------------------------


def brute_log10(word, vocabulary, logp):
    """Sum over all segmentations by recursion."""
    text = lattice.MARK + word
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.kinds[i] == "normal"}

    def ways(at):
        if at == len(text):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end]
            if piece in ids:
                total += math.exp(logp[ids[piece]]) * ways(end)
            elif end == at + 1:
                total += math.exp(sum(logp[vocabulary.bytes[b]] for b in piece.encode())) * ways(end)
        return total

    return math.log10(ways(0))


def test_lattice_sums_all_segmentations():
    own = lattice.load()
    logp = lm.first_weights(own)[:-1]
    assert abs(np.exp(lm.first_weights(own)).sum() - 1) < 1e-9
    words = ["the", "thonretiin", "x", "né", "日本龘", "1a2b", "ab\x00"]
    found = lattice.log_probabilities(words, own, logp) / math.log(10)
    assert np.allclose(found, [brute_log10(w, own, logp) for w in words], atol=1e-9)


def test_expected_counts_are_the_gradient():
    own = lattice.load()
    logp = lm.first_weights(own)[:-1]
    words, counts = ["thonre", "né龘", "there"], np.array([2.0, 1.0, 3.0])
    e = lattice.expected_counts(words, counts, own, logp)
    for piece in (own.pieces.index("▁th"), int(own.bytes["龘".encode()[0]])):
        moved = logp.copy()
        moved[piece] += 1e-6
        slope = (lattice.log_probabilities(words, own, moved) - lattice.log_probabilities(words, own, logp)) @ counts / 1e-6
        assert abs(slope - e[piece]) < 1e-4


def test_long_words_equal_short_ones(monkeypatch):
    own = lattice.load()
    logp = lm.first_weights(own)[:-1]
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh龘é▁"), n)) for n in (5, 40, 90, 300)]
    whole = lattice.log_probabilities(words, own, logp), lattice.expected_counts(words, np.arange(4) + 1.0, own, logp)
    monkeypatch.setattr(lattice, "LONG", 30)
    assert np.allclose(lattice.log_probabilities(words, own, logp), whole[0])
    assert np.allclose(lattice.expected_counts(words, np.arange(4) + 1.0, own, logp), whole[1])


def check_scores(found, texts):
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1 for i, _ in texts}
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in texts]
    counts = Counter()
    for i, own in tokens:
        if not held[i]:
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, own in tokens:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        expected[i, held[i], len(own), sum(counts[w] > 0 for w in own), n, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_lm_on_odd_rows(docs, no_docs):
    small = docs.where("doc_id <> 4 OR doc_id IS NULL")
    held = common.fold_of(F.col("doc_id")) == 1
    found = rows(lm.score_documents(small, held, block_bytes=200))
    check_scores(found, [(r.doc_id, r.text) for r in small.collect()])
    assert len({r["score"] for r in found if r["doc_id"] in (2, 3, 8)}) == 1  # the end alone
    assert rows(lm.score_documents(no_docs, held)) == []
    alone = rows(lm.score_documents(small.where("doc_id = 1"), F.lit(True)))
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


def test_lm_query(spark, sf):
    found = rows(lm.op8_subword_lattice_lm(spark, sf))
    check_scores(found, [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()])
    per_token = lambda k: np.mean([r["score"] / r["n_tokens"] for r in found if r["held_out"] == k])
    assert per_token(True) > 1.2 * per_token(False)  # held-out texts fit almost as well


# --- pieces ----------------------------------------------------------------------------------------------------


def test_viterbi_is_the_best_segmentation():
    own = pieces.codec()
    ids = {p: i for i, p in enumerate(own.vocabulary.pieces) if own.vocabulary.kinds[i] == "normal"}

    def best(text):
        top = [0.0] + [-math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for at in range(end):
                piece = text[at:end]
                score = own.vocabulary.scores[ids[piece]] if piece in ids else own.unknown if end == at + 1 else -math.inf
                top[end] = max(top[end], top[at] + score)
        return top[-1]

    for text in ("▁the", "▁thonretiin", "▁Grüße", "日本龘x龘", "▁1234abc", "龘", "▁▁▁", "▁▁▁▁the▁▁x"):
        score, parts = own.segment(text)
        assert abs(score - best(text)) < 1e-6
        assert "".join(text[a:b] for a, b, _ in parts) == text
        assert all(i is None or own.vocabulary.pieces[i] == text[a:b] for a, b, i in parts)


def test_stretches_don_t_change_the_result():
    own = pieces.codec()
    for text in ("two  spaces", " lead", "trail ", "line\nbreak\n\nend", "a b", "a" + " " * 40 + "b", " " * 20):
        whole = own._ids("▁" + text.replace(" ", "▁"))
        assert tuple(own.encode(text)) == whole


def test_every_text_comes_back():
    own = pieces.codec()
    for text in ("▁", " ▁ ", "▁▁a ▁b▁", "a▁b", "\n▁\n", " ", "  ", "𝄞 \u0000 é", "x" * 20_000 + "▁" + " " * 5_000):
        ids = own.encode(text)
        assert own.decode(ids) == text
    assert own.literal_mark == own.vocabulary.bytes[list("▁".encode())].tolist() and len(own.memory) <= pieces.REMEMBERED
    assert all(len(k) <= pieces.SHORT for k in own.memory)


def test_pieces_of_marks_that_score_well_are_used(monkeypatch):
    """With a vocabulary in which a run of marks is worth it, runs stay together."""
    base = lattice.load()
    scores = base.scores.copy()
    scores[base.pieces.index("▁▁▁▁")] = 0.0
    monkeypatch.setitem(lattice._LOADED, "other", lattice.Vocabulary(base.pieces, scores.tolist(), base.kinds))
    own = pieces.Codec("other")
    ids = own.encode("a" + " " * 9 + "b")
    assert [base.pieces[i] for i in ids].count("▁▁▁▁") == 2 and own.decode(ids) == "a" + " " * 9 + "b"
    assert tuple(ids) == own._ids("▁a" + "▁" * 9 + "b")


def test_pieces_on_odd_rows(docs, no_docs):
    encoded = pieces.encode(docs)
    back = Counter((r.doc_id, r.text) for r in pieces.decode(encoded).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert pieces.decode(pieces.encode(no_docs)).count() == 0
    assert pieces.codec().decode(None) is None


def test_pieces_query(spark, sf):
    found = rows(pieces.op4_sentencepiece_viterbi(spark, sf))
    assert len(found) == common.table(spark, sf, "documents").count() and all(r["round_trip"] for r in found)
