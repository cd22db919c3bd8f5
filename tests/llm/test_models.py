"""Vectors, classifiers and the pipeline: against brute force, on held-out rows and on odd rows."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.llm import common, kneser_ney, labelled, nndescent, quality, simhash, toxicity


def brute_links(rows, threshold=0.93):
    """{row number: linked rows} by all pairs."""
    usable = {}
    for i, (_, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, float)
        usable[i] = (label, x / np.linalg.norm(x))
    links = defaultdict(set)
    for i, (a, x) in usable.items():
        for j, (b, y) in usable.items():
            if i < j and a == b and len(x) == len(y) and x @ y >= threshold:
                links[i].add(j)
                links[j].add(i)
    return links


def brute_near(rows, threshold=0.93):
    links = brute_links(rows, threshold)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((row[0], len(links[i]), min(rows[j][0] for j in seen)))
    return sorted(out)


def clusters(seed=0, n=120, copies=60, width=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, width))
    rows = [(i, base[i].tolist(), i % 3) for i in range(n)]
    for k in range(8):
        rows.append((1000 + k, (base[k] + rng.normal(size=width) * 0.12).tolist(), k % 3))
    rows += [(2000 + k, (base[50] + rng.normal(size=width) * 0.15).tolist(), 50 % 3) for k in range(copies)]
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = clusters()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect())
    assert found == brute_near(rows)


def test_near_duplicates_on_odd_rows(spark):
    v, nan, inf = [1.0, 0.0, 0.5], float("nan"), float("inf")
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, [2.0, 0.0, 1.0], 0), (4, v, 1), (5, v, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [nan, 1.0, 0.0], 0), (9, [1.0, None, 0.0], 0), (10, [inf, 0.0, 0.0], 0), (11, [], 0), (12, [1.0, 0.5], 0), (13, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, label int, rid int, n int, vec string")
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in nndescent.near_duplicates(df).collect())
    assert found == brute_near(rows)
    assert {r.vec_id: r.kept for r in nndescent.near_duplicates(df).collect()}[3] is False
    assert nndescent.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0


def test_blocks_count_every_link(spark):
    rows = [(i, x, 0) for i, (_, x, _) in enumerate(clusters(3, 60, 150)[68:])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.classes(common.ready(spark) and df)
    roots = nodes.select(F.col("rid").alias("node"), F.lit(0).cast("long").alias("root"))
    counted = nndescent.count_links(nodes, roots, 0.93).join(nodes, "rid").select("first_id", "others").collect()
    links = brute_links(rows)
    assert {r.first_id: r.others for r in counted} == {i: len(links[i]) for i in range(len(rows))}
    pairs = nndescent.exact_links(nodes, 0.93)
    assert nndescent.audit(nodes, pairs, roots, nndescent.count_links(nodes, roots, 0.93), 0.93)[0] == 1.0


def test_large_and_small_values_link(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.0001e200], 0), (3, [1e-200, 1e-200], 0), (4, [5e-324, 5e-324], 0), (5, [1.7e308, 1.7e308], 0), (6, [1.0, -1.0], 0)]
    found = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (4, 1) for i in range(1, 6)} | {6: (0, 6)}


def test_audit_sees_what_was_missed(spark):
    """One large group has most links; the pairs beside it are what the audit must not overlook."""
    rng = np.random.default_rng(5)
    hub = rng.normal(size=24)
    rows = [(i, (hub + rng.normal(size=24) * 0.05).tolist(), 0) for i in range(400)]
    for i in range(300):
        x = rng.normal(size=24)
        rows += [(1000 + 2 * i, x.tolist(), 0), (1001 + 2 * i, (x + rng.normal(size=24) * 0.05).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.classes(common.ready(spark) and df)
    full = common.materialise(nndescent.exact_links(nodes, 0.93), "test")
    ids = {r.rid: r.first_id for r in nodes.collect()}
    group = full.where(F.col("a").isin([k for k, v in ids.items() if v < 400]))
    empty = spark.createDataFrame([], "rid long, others long")
    for links, least in ((full, 1.0), (group, 0.0)):
        roots = nndescent.ranked_components(links, nodes.select("rid", "first_id"), "rid", "first_id").select(F.col("rid").alias("node"), F.col("root_key").alias("root"))
        found, of_graph, asked = nndescent.audit(nodes, links, roots, nndescent.count_links(nodes, roots, 0.93), 0.93)
        assert found == least and of_graph <= 1 and asked > 200
    assert nndescent.audit(nodes, full.limit(0), roots.limit(0), empty, 0.93)[:2] == (0.0, 0.0)


def test_sparse_links_are_audited(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=24).tolist(), 0) for i in range(3000)]
    rows.append((3001, rows[7][1][:-1] + [rows[7][1][-1] + 1e-3], 0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    nodes = nndescent.classes(common.ready(spark) and df)
    none = spark.createDataFrame([], "a long, b long")
    roots = spark.createDataFrame([], "node long, root long")
    assert nndescent.audit(nodes, none, roots, spark.createDataFrame([], "rid long, others long"), 0.93) == (0.0, 0.0, 2)


def test_exact_search_takes_over_where_recall_stays_low(spark):
    rows = clusters(11, 300, 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = nndescent.near_duplicates(df, orders=1, recall=1.1, most_orders=1).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == brute_near(rows) and {r.audited_recall for r in found} == {1.0}


def test_rounds_find_links_that_the_first_graph_misses(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(60, 48))
    rows = [(20 * i + k, (base[i] + rng.normal(size=48) * 0.18).tolist(), 0) for i in range(60) for k in range(20)]
    monkeypatch.setattr(nndescent, "AROUND", 3)
    nodes = nndescent.classes(common.ready(spark) and spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    ids = {r.rid: r.first_id for r in nodes.collect()}
    true = {(i, j) for i, own in brute_links(rows).items() for j in own if i < j}
    number = {r[0]: i for i, r in enumerate(rows)}
    count = lambda rounds: len(true & {tuple(sorted((number[ids[r.a]], number[ids[r.b]]))) for r in nndescent.descend(nodes, 2, 0.93, rounds).collect()}) / len(true)
    assert count(0) < 0.6 and count(6) > 0.9


def test_near_duplicates_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in common.table(spark, sf, "embeddings").collect()]
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in nndescent.op1_nn_descent_near_duplicates(spark, sf).collect())
    assert found == brute_near(rows)


def plain_symbols(text, numbers):
    """Marks and characters' numbers of one text, by a loop."""
    out = []
    for c in text.lower():
        n = int(numbers[ord(c)])
        if n or (out and out[-1]):
            out.append(n)
    return out if not out or out[-1] == 0 else [*out, 0]


def plain_grams(text, numbers, order):
    own = [0] * (order - 1) + plain_symbols(text, numbers)
    return [tuple(own[i - order + 1 : i + 1]) for i in range(order - 1, len(own))]


class PlainKneserNey:
    """Probabilities by the definition, one symbol at a time."""

    def __init__(self, grams_by_class, order, shared):
        self.order, self.shared = order, shared
        self.counts = []
        for grams in grams_by_class:
            by = {order: Counter(grams)}
            for n in range(order - 1, shared, -1):
                by[n] = Counter(g[1:] for g in by[n + 1])
            self.counts.append(by)
        longer = set(self.counts[0][shared + 1]) | set(self.counts[1][shared + 1])
        self.low = Counter(g[1:] for g in longer)

    def p(self, k, gram):
        n = len(gram)
        if n == self.shared:
            return (self.low[gram] + 1) / (sum(c for g, c in self.low.items() if g[:-1] == gram[:-1]) + kneser_ney.CHARACTERS)
        mine = {g: c for g, c in self.counts[k][n].items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return self.p(k, gram[1:])
        left = kneser_ney.DISCOUNT * len(mine) / total
        return max(mine.get(gram, 0) - kneser_ney.DISCOUNT, 0) / total + left * self.p(k, gram[1:])


def test_kneser_ney_equals_its_definition():
    texts = [["abc abd, abc", "bca  a_1 abca"], ["xyz! xya abd", "", "zab abd abc zz"]]
    order, shared = 4, 1
    alphabet = kneser_ney.Alphabet(sum(texts, []))
    pack = lambda g: sum(s << kneser_ney.BITS * (len(g) - 1 - i) for i, s in enumerate(g))
    for own in texts:
        found, counts = alphabet.counts(own, order)
        expected = Counter(pack(g) for t in own for g in plain_grams(t, alphabet.numbers, order))
        assert dict(zip(found.tolist(), counts.tolist())) == expected
    model = kneser_ney.Model(*(alphabet.counts(own, order) for own in texts), order, shared)
    plain = PlainKneserNey([[g for t in own for g in plain_grams(t, alphabet.numbers, order)] for own in texts], order, shared)
    asked = [g for t in [*sum(texts, []), "abz q cab ABC", "_1 xx yy\n\tzz"] for g in plain_grams(t, alphabet.numbers, order)]
    expected = [np.log(plain.p(0, g) / plain.p(1, g)) for g in asked]
    assert np.allclose(model.ratios(np.array([pack(g) for g in asked])), expected)
    for k in (0, 1):  # seen, half-seen and unseen contexts
        for context in ((0, 0, 0), asked[3][1:], asked[-1][1:], (9, 9, 9)):
            assert abs(sum(plain.p(k, (*context, s)) for s in range(kneser_ney.CHARACTERS)) - 1) < 1e-6


def test_passages_are_compared_by_length():
    texts = ["you are a worthless clown", "the river runs under the stone", "", None, " .. ", "one river " * 50 + "worthless", "you are", "x" * 50]
    alphabet = kneser_ney.Alphabet(texts)
    toxic, ordinary = ["worthless clown you are a clown"] * 3, ["the river runs under one stone you are here"] * 3
    model = kneser_ney.Model(alphabet.counts(toxic), alphabet.counts(ordinary))
    found = toxicity.passage_differences(model, alphabet, texts)
    assert found[0] > 0.5 and found[5] > 0.5 and found[1] < 0.2 and (found[2:5] == 0).all()
    for text, value in zip(texts, found):
        words, best = [], []
        for word in re.findall(r"\w+", (text or "").lower()):
            words.append(word)
        joined = " ".join(words)
        grams = np.array([sum(s << kneser_ney.BITS * (kneser_ney.ORDER - 1 - i) for i, s in enumerate(g)) for g in plain_grams(joined, alphabet.numbers, kneser_ney.ORDER)], np.int64)
        ratios, at = model.ratios(grams), 0
        own = []
        for w in words:
            own.append((ratios[at : at + len(w) + 1].sum(), len(w) + 1))
            at += len(w) + 1
        for n in range(1, toxicity.PASSAGE + 1):
            best += [sum(r for r, _ in own[i : i + n]) / max(toxicity.LEAST, sum(k for _, k in own[i : i + n])) for i in range(len(own) - n + 1)]
        assert abs(value - max(best, default=0.0)) < 1e-6


def test_long_texts_are_read_whole(monkeypatch):
    monkeypatch.setattr(kneser_ney, "STRETCH", 100)
    text = "plain words and more of them " * 40
    parts = [p for _, own in kneser_ney.stretches([text, None, "short", text + "x" * 250]) for p in own]
    assert "".join(parts) == text + "short" + text + "x" * 250 and max(map(len, parts)) <= 100
    texts = [text + "worthless clown " + text, text]
    alphabet = kneser_ney.Alphabet(texts)
    model = kneser_ney.Model(alphabet.counts(["worthless clown"]), alphabet.counts([text]))
    found = toxicity.passage_differences(model, alphabet, texts)
    assert found[0] > 1 > found[1]


def test_random_indexing_is_deterministic():
    a, b = quality.index_vector("word"), quality.index_vector("word")
    assert (a[0] == b[0]).all() and len(set(a[0].tolist())) == quality.NONZERO and set(a[1].tolist()) <= {1.0, -1.0}
    assert quality.shape("THE!!") == "\0X!!" and quality.shape("the12***") == "\0x9***" and quality.shape("Word") == "\0Xx"


def test_word_vectors_equal_plain_loops(monkeypatch):
    """Random indexing word by word: own index vector and the sum of the neighbours' ones, each of length one; pooling by parts."""
    monkeypatch.setattr(quality, "FREQUENT", 2)
    monkeypatch.setattr(quality, "PART", 5)
    texts = ["the river runs by the old stone", "the old stone by the River 42", "new new words under the cloud by 77 rivers!", "the stone"]
    own = quality.Vectors(texts)

    def name(token, before):
        if token == before:
            return quality.SAME
        return token if token in own.number else quality.shape(token) if quality.shape(token) in own.number else quality.UNKNOWN

    def named(text):
        words = text.split()
        return [name(w, b) for w, b in zip(words, [None, *words])]

    def index(n):
        v = np.zeros(quality.WIDTH)
        for place, sign in zip(*quality.index_vector(n)):
            v[place] = sign
        return v

    context = defaultdict(lambda: np.zeros(quality.WIDTH))
    for t in texts:
        names = named(t)
        for i, n in enumerate(names):
            for j in range(max(0, i - quality.WINDOW), min(len(names), i + quality.WINDOW + 1)):
                if i != j:
                    context[n] += index(names[j])
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    vector = {n: unit(index(n)) + unit(context[n]) for n in own.number}
    for n, at in own.number.items():
        assert np.allclose(own.table[at], vector[n], atol=1e-6)
    for t in [*texts, "river Stone 9 unseen-word the the", ""]:
        rows = [vector[n] for n in named(t)]
        expected = np.zeros(2 * quality.WIDTH)
        if rows:
            mean = np.mean(rows, 0)
            parts = [rows[i : i + 5] for i in range(0, len(rows), 5)]
            spread = np.sqrt(sum(len(p) * (np.mean(p, 0) - mean) ** 2 for p in parts) / len(rows))
            expected = np.concatenate([mean, spread])
        assert np.allclose(own.pool(own.numbers(t.split(), {})), expected, atol=1e-5)


def test_network_equals_plain_layers():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(80, 6)), (rng.random(80) < 0.5).astype(int)
    x[y == 1, 0] += 3
    net = quality.Network(x, y, np.ones(80))
    net.calibrate(x, y, np.ones(80))
    w1, b1, w2, b2 = net.p
    for row, p in zip(x, net(x)):
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale)]
        hidden = [max(0.0, sum(z[i] * w1[i, j] for i in range(6)) + b1[j]) for j in range(quality.HIDDEN)]
        assert abs(p - 1 / (1 + np.exp(-(np.dot(hidden, w2) + b2[0]) / net.temperature))) < 1e-9
    assert np.mean((net(x) > 0.5) == y) > 0.9 and net.temperature >= 1


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled_docs(spark):
    rng = np.random.default_rng(4)
    good, bad, ugly = ["river", "stone", "cloud", "meadow", "light", "walks", "under", "the"], ["BUY!!", "NOW!!", "$$$", "||"], ["zorgface", "blugnut"]
    docs, labels = [], []
    for i in range(400):
        words = rng.choice(good, 40).tolist()
        q, t = int(rng.random() < 0.7), int(rng.random() < 0.3)
        if not q:
            words = rng.choice(bad, 40).tolist()
        if t:
            words[5] = str(rng.choice(ugly)) + str(rng.choice(["", "s", "ish"]))
        docs.append((i, " ".join(words)))
        labels.append((i, q, t))
    docs += [(500, None), (501, ""), (502, " ".join(good * 5000)), (503, docs[3][1]), (503, docs[3][1]), (None, docs[5][1]), (504, "日本 語")]
    labels += [(500, None, 1), (None, 1, 1), (3, labels[3][1], labels[3][2]), (9999, 1, 0), (501, 7, 0)]
    return spark.createDataFrame([(*d, 1.0, "x", 2) for d in docs], "doc_id long, text string, score double, y string, held_out int"), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_generalise(spark, labelled_docs, module, label):
    common.ready(spark)
    docs, labels = labelled_docs
    found = toxicity.score(docs, module.fit(docs, labels), module.THRESHOLD).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in found)
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(held) > 40 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert len({r.score for r in found if r.doc_id == 503} | {r.score for r in found if r.doc_id == 3}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_rows(spark, labelled_docs, module):
    docs, labels = labelled_docs
    classifier = module.fit(docs, spark.createDataFrame([], LABELS))
    assert {r.score for r in toxicity.score(docs, classifier, 0.5).collect()} == {0.5}
    none = spark.createDataFrame([], docs.schema)
    assert toxicity.score(none, module.fit(none, labels), 0.5).count() == 0
    assert toxicity.keep(docs, classifier, 0.5, 1).count() == docs.count()


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark, labelled_docs):
    docs, labels = labelled_docs
    texts, y, prior = labelled.sample(docs, labels, "toxic", per_class=30)
    assert np.bincount(y).max() <= 30 and 0.15 < prior < 0.45 and len(texts) == len(y)
    held = {r.text for r in docs.where(labelled.held_out()).collect()}
    assert len([t for t in texts if t in held]) < 5  # equal texts of other ids


def test_sample_takes_labelled_documents_alone(spark, labelled_docs):
    """Neither labels of documents that aren't there nor long texts of a class thin out the sample."""
    docs, labels = labelled_docs
    others = spark.range(10_000, 90_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    texts, y, prior = labelled.sample(docs, labels, "quality")
    more = labelled.sample(docs, labels.unionByName(others), "quality")
    assert more[0] == texts and (more[1] == y).all() and more[2] == prior and len(texts) > 300
    half = docs.where("doc_id < 200")  # as a later stage of a pipeline gets them
    assert len(labelled.sample(half, labels, "quality", per_class=150)[0]) > 120
    long = docs.join(labels.select("doc_id", "quality"), "doc_id").withColumn("text", F.when(F.col("quality") == 1, F.repeat("text", 400)).otherwise(F.col("text")))
    texts, y, _ = labelled.sample(long, labels, "quality")
    assert y.sum() > 150 and min(len(t) for t, q in zip(texts, y) if q) > 65_536
    texts, y, _ = labelled.sample(long, labels, "quality", class_bytes=1 << 20)
    assert 2 <= y.sum() <= 16 and (y == 0).sum() > 60


@pytest.mark.parametrize("op,label", [(quality.op5_quality_random_indexing, "quality"), (toxicity.op9_toxicity_kneser_ney, "toxic")])
def test_classifier_queries(spark, op, label):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r[label] for r in common.table(spark, sf, "labels").collect()}
    found = [r for r in op(spark, sf).collect() if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) >= 0.97


def test_pipeline_by_stages(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    rows, columns = docs.count(), docs.columns
    given = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in given.collect()}
        given = common.materialise(stage(spark, given, sf), name)
        after = {r.doc_id: r for r in given.collect()}
        assert given.columns == columns and all(before[i] == r for i, r in after.items()) and 0 < len(after) <= len(before)
        if name == "near_duplicates":
            ids = sorted(before)
            prints = [simhash.fingerprint(simhash.shingle_hashes(before[i].text)) for i in ids]
            from tests.llm.test_texts import brute_components, brute_kept

            first = [i for i, c in zip(ids, brute_components(ids, prints, 4)) if i == c]
            sets = {i: simhash.shingle_set(before[i].text) for i in first}
            alike = {i: [j for j in first if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in first}
            assert set(after) <= set(first) and all(min(alike[i]) < i or len(alike[i]) > 1 for i in set(first) - set(after))
            assert all(i in after for i in first if alike[i] == [i])
            assert set(after) == brute_kept([(i, before[i].text) for i in ids])
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == set(after) and len(after) < rows


def test_pipeline_on_odd_rows(spark, docs, sf):
    import corpus_pipeline

    given = docs
    for name, stage in corpus_pipeline.STAGES:
        given = common.materialise(stage(spark, given, sf), name)
    assert given.count() >= 0
