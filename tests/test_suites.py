"""Trained pair scorers, monotone and saved models, suites, sources and sinks of the suites."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.config import Channel, EngineConfig
from linkwright.functions.hashing import fold_of
from linkwright.operators import blocking, models, pair_encoder, sampling, shift, suites
from linkwright.plans import linkage
from linkwright.session import scratch, stage
from linkwright.sources import readers, sinks

WORDS = "river stone cloud meadow light walker harbor garden winter silver copper maple orchid falcon".split()


def text_pairs(n=300, seed=1):
    rng = np.random.default_rng(seed)
    pairs, y = [], []
    for i in range(n):
        a = " ".join(rng.choice(WORDS, 3))
        b = a + " ltd" if i % 2 else " ".join(rng.choice(WORDS, 3))
        pairs.append((a, b))
        y.append(float(i % 2))
    return pairs, y


def test_encoder_learns_and_repeats():
    pairs, y = text_pairs()
    own = pair_encoder.PairEncoder(3).train(pairs[:200], y[:200])
    z = np.array(own(pairs[200:]))
    assert np.mean((z > 0) == np.array(y[200:])) > 0.9
    again = pair_encoder.PairEncoder(3).train(pairs[:200], y[:200])
    assert again(pairs[200:]) == own(pairs[200:])
    assert np.isfinite(own([(None, None), ("", "x"), ("日本", "y" * 5000)])).all() and own([]) == []


def test_encoder_gradients_by_differences():
    pairs, y = text_pairs(8)
    own = pair_encoder.PairEncoder(1)
    _, grads = own.gradients(pairs, np.array(y))
    token = pair_encoder.tokens(pairs[0][0])[0]
    for name, at in (("product", 3), ("gap", 5), ("bias", 0), ("table", (token, 2))):
        values = []
        for step in (1e-5, -1e-5):
            moved = own.copy()
            moved.p[name][at] += step
            values.append(moved.gradients(pairs, np.array(y))[0])
        assert abs((values[0] - values[1]) / 2e-5 - grads[name][at]) < 1e-5


@pytest.fixture(scope="module")
def candidates(spark):
    pairs, y = text_pairs(160, 4)
    texts = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)] + [(1000 + i, b) for i, (_, b) in enumerate(pairs)], "rid long, text string")
    rows = spark.createDataFrame([(i, 1000 + i, int(v), i % 5, "a" if i % 3 else "b", 0.99 if v else 0.01) for i, v in enumerate(y)], "q long, p long, y int, fold int, grp string, prob double")
    return rows, texts


def test_encoder_routes(spark, candidates):
    rows, texts = candidates
    scored = pair_encoder.cross_fit(rows, texts).collect()
    assert len(scored) == 160 and {r.half for r in scored if r.fold in (1, 2)} == {"B"} and {r.half for r in scored if r.fold in (3, 4)} == {"A"}
    assert np.mean([(r.ce_logit > 0) == (r.y == 1) for r in scored]) > 0.8
    out = pair_encoder.leave_group_out(rows, texts, "grp", "b").collect()
    assert len(out) == rows.where("grp = 'b'").count() and np.mean([(r.ce_logit > 0) == (r.y == 1) for r in out]) > 0.8
    base = pair_encoder.fit(rows.where("grp = 'a'"), texts, epochs=1)
    adapted = pair_encoder.self_train(base, rows.where("grp = 'a'"), rows.where("grp = 'b'").drop("y"), texts).collect()
    assert len(adapted) == len(out) and all(np.isfinite(r.ce_logit) for r in adapted)
    found = {r.variant: r.log_loss for r in pair_encoder.gates(pair_encoder.cross_fit(rows.withColumn("prob", F.lit(0.5)), texts)).collect()}
    assert set(found) == {"first", "encoder", "combined"} and found["combined"] < found["first"]


def model_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, int(rng.random() < 0.2 + 0.6 * (i % 10) / 9), i % 5, (i % 10) / 9, float(rng.random())) for i in range(600)]
    return spark.createDataFrame(rows, "q long, p long, y int, fold int, a double, b double")


def test_monotone_and_saved_models(spark):
    rows = model_rows(spark)
    for scorer, flag in ((models.MonotoneScorer(rising=["a"]), "rises"), (models.MonotoneScorer(falling=["a"]), "falls")):
        score = scorer.fit(rows, ["a", "b"])
        assert models.is_monotone(models.partial_dependence(rows, score, "a", [0, 0.25, 0.5, 0.75, 1])).first()[flag]
    assert abs(models.MonotoneScorer(falling=["a"]).fit(rows, ["a", "b"]).model.coefficients[0]) < 1e-6  # the data rise
    for scorer in (models.logistic(), models.regularised(3)):
        score, path = scorer.fit(rows, ["a", "b"]), scratch(spark, "model")
        models.save_model(score, path)
        before, after = (f(rows).orderBy("q").select("prob").toPandas().prob.to_numpy() for f in (score, models.load_model(path, ["a", "b"])))
        assert np.allclose(before, after)


def test_ablation_adaptation_and_distance(spark):
    rows = model_rows(spark).withColumn("grp", F.when(F.col("q") % 2 == 0, "x").otherwise("y"))
    truth, queries = rows.where("y = 1").select("q", "p"), rows.select("q")
    found = {r.features: r.macro_f05 for r in suites.ablation(rows, {"both": ["a", "b"], "noise": ["b"]}, models.logistic(), "thr0.5", truth, queries).collect()}
    assert found["both"] > found["noise"]
    out = suites.adaptation(rows, "grp", ["x"], ["a", "b"], models.logistic(), "thr0.5", queries).collect()
    assert {r.variant for r in out} == {"source", "adapted"} and all(0 <= r.macro_f05 <= 1 for r in out)
    ks = suites.fold_average_distance(rows, ["a", "b"], models.logistic(), rows.where("q % 7 = 0").drop("fold")).first().ks
    assert 0 <= ks < 0.5


def test_exact_distance_and_priors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random(500) ** 2, rng.random(300)
    make = lambda v: spark.createDataFrame([(float(x),) for x in v], "prob double")
    values = np.concatenate([a, b])
    expected = max(abs((a <= v).mean() - (b <= v).mean()) for v in values)
    for cells in (10_000, 3):
        assert abs(models.ks_distance(make(a), make(b), cells=cells).first().ks - expected) < 1e-12
    pi = 0.3
    for _ in range(200):
        x, z = pi / 0.3 * a, (1 - pi) / 0.7 * (1 - a)
        pi = float((x / (x + z)).mean())
    one = shift.em_prior(make(a).withColumn("g", F.lit(1)), "g", 0.3).first()
    assert abs(one.prior - pi) < 1e-5


def test_first_by_hash_is_the_smallest(spark):
    rows = spark.range(5000).select(F.col("id").alias("q"), (F.col("id") % 7).alias("p"))
    order = [r.q for r in rows.orderBy(sampling.hash_order("q", "p"), "q").collect()]
    for n in (0, 1, 700, 4999, 5000, 9000):
        assert sorted(r.q for r in sampling.first_by_hash(rows, ["q", "p"], n).collect()) == sorted(order[:n])


def test_bfloat16(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=500) * 10.0 ** np.arange(-5, 5).repeat(50), [0.0, 1.0, -2.0, 0.1, 255.5, 1.00390625, 1.01171875]])
    u = values.astype(np.float32).view(np.uint32)
    expected = ((u + 0x7FFF + ((u >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    found = [r.b for r in df.select("i", models.bfloat16(F.col("v")).alias("b")).orderBy("i").collect()]
    assert np.array_equal(np.array(found), expected.astype(float))


def test_rules_and_validation(spark):
    scored = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (2, 10, 0.7)], "q long, p long, prob double")
    queries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q long, grp string")
    found = {r.grp: (r.n_queries, r.mean_size, r.empty) for r in suites.probe(scored, "thr0.55", queries, "grp").collect()}
    assert found == {"a": (2, 1.0, 0.5), "b": (1, 0.0, 1.0)}
    with pytest.raises(ValueError):
        suites.rule("anything")
    sets = spark.createDataFrame([(0, "1", "10,11"), (1, "2", "")], "position int, q_id string, ids string")
    asked, pool = sets.select("position", "q_id"), spark.createDataFrame([("10",), ("11",)], "p_id string")
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    sinks.write_sets(sets, good, "ids", one_file=True)
    sinks.write_sets(sets.withColumn("ids", F.lit("99")), bad, "ids")
    assert sinks.validate(spark, good, good, asked, pool).count() == 11
    with pytest.raises(ValueError, match="id not in the pool"):
        sinks.validate(spark, bad, good, asked, pool)


def test_asked_queries_keep_all_weights(spark):
    records = spark.createDataFrame([(i, "US", i < 8, f"river stone{i % 3}", f"riverstone{i % 3}") for i in range(30)], "rid long, country string, is_query boolean, n_core string, n_compact string")
    records = records.withColumns({"n_skel": F.lit(""), "n_cons": F.lit("")})
    channels = {"gram": Channel({"gram": 1.0}, 5)}
    whole = {(r.q, r.p): r.s_gram for r in blocking.candidates(records, channels).collect()}
    some = {(r.q, r.p): r.s_gram for r in blocking.candidates(records, channels, asked=F.col("rid") < 3).collect()}
    assert some == {k: v for k, v in whole.items() if k[0] < 3} and some


def test_truth_by_key_counts_what_pairs_list(spark):
    rows = [(i, "US" if i % 7 else "IN", i % 4 == 0, f"river stone{i % 3}", f"{'rso'[i % 3]}iverstone{i % 3}", "", "") for i in range(60)]
    records = spark.createDataFrame(rows, "rid long, country string, is_query boolean, n_core string, n_compact string, n_skel string, n_cons string")
    key, channels = F.substring("n_compact", 1, 1), {"gram": Channel({"gram": 1.0}, 5)}
    side = lambda k, f: records.where(f).select(F.col("rid").alias(k), "country", key.alias("start"))
    truth = side("q", "is_query").join(side("p", "NOT is_query"), ["country", "start"]).select("q", "p")
    found, expected = (sorted(map(tuple, suites.blocking_benchmark(records, t, channels, 0.8).collect())) for t in (key, truth))
    assert found == expected and len(found) > 1


def test_stack_is_fitted_and_used(spark):
    names = ["north river", "silver stone", "maple garden", "winter cloud", "copper harbor", "orchid meadow"]
    rows = []
    for i in range(60):
        name = f"{names[i % 6]} {WORDS[i % 14]}"
        rows += [(i, "US", True, 1, name, f"{i} main street"), (100 + i, "US", False, 2, name + " llc", f"{i} main st"), (200 + i, "US", False, 3, f"{names[(i + 1) % 6]} {WORDS[i % 14]}", f"{i + 3} oak road")]
    normal = stage(linkage.normalise(spark.createDataFrame(rows, "rid long, country string, is_query boolean, src int, name string, address string")), "test")
    truth = spark.createDataFrame([(i, 100 + i) for i in range(60)], "q long, p long")
    channels = {"name": Channel({"name": 1.0}, 4), "addr": Channel({"addr": 1.0}, 4)}
    described = linkage.described_pairs(normal, truth, channels, fold_of(F.col("q").cast("string")))
    infer = linkage.fit_stack(described, normal, models.logistic(), models.logistic())
    held = infer(described.where("fold = 0"), normal).collect()
    assert held and np.mean([(r.prob > 0.5) == (r.y == 1) for r in held]) > 0.9


def test_scores_come_back_by_key(spark):
    path = scratch(spark, "scores")
    scored = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.25)], "q long, p long, prob double")
    sinks.write_scores(scored, path)
    back = readers.read_scores(spark, path, scored.select("q", "p").orderBy(F.desc("q")), "p2")
    assert {(r.q, r.p, r.p2) for r in back.collect()} == {(1, 2, 0.5), (3, 4, 0.25)}
    assert EngineConfig().source("train", 1).endswith("train_source1.tsv")


def test_labels_come_from_keys_without_a_list_of_true_pairs(spark):
    records = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, ""), (4, ""), (5, None), (6, "abd")], "rid long, k string")
    pairs = spark.createDataFrame([(1, 2), (1, 6), (3, 4), (5, 2), (1, 4)], "q long, p long")
    assert {(r.q, r.p): r.y for r in blocking.label_same(pairs, records, F.col("k")).collect()} == {(1, 2): 1, (1, 6): 0, (3, 4): 0, (5, 2): 0, (1, 4): 0}


@pytest.mark.parametrize("name", ["encoder_scores", "encoder_gates"])
def test_encoders_describe_no_pairs(spark, sf, name, monkeypatch):
    from linkwright.queries import suites as own

    def refuse(*_, **__):
        raise AssertionError("features are made that nothing reads, or true pairs listed")

    monkeypatch.setattr(linkage, "describe", refuse)
    monkeypatch.setattr(blocking, "label_pairs", refuse)
    assert own.QUERIES[name](spark, sf).count() > 0


def test_equal_texts_are_scored_once(spark):
    texts = spark.createDataFrame([(i, "same" if i % 2 else "other") for i in range(40)], "rid long, text string")
    pairs = spark.createDataFrame([(i, 39 - i, "A") for i in range(40)], "q long, p long, half string").coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def scorer(own):
        seen.add(len(own))
        return [float(len(a)) for a, _ in own]

    found = {r.q: r.ce_logit for r in models.second_scores(pairs, texts, {"A": scorer}).collect()}
    assert found == {i: 4.0 if i % 2 else 5.0 for i in range(40)} and seen.value < 40


def test_texts_are_normalised_once_with_the_same_columns(spark):
    rows = [(i, "us", i % 2 == 0, 1, n, a) for i, (n, a) in enumerate([("Red Fox Ltd.", "12b Main St"), ("Red Fox Ltd.", ""), ("", "12b Main St"), (None, None), ("Café Élan", "n/a"), (None, "x")] * 3)]
    records = spark.createDataFrame(rows, "rid long, country string, is_query boolean, src int, name string, address string")
    plain, once = linkage.normalise(records), linkage.normalise_once(records)
    assert set(once.columns) == set(plain.columns)
    listed = lambda df: df.select(*plain.columns).orderBy("rid").collect()
    assert listed(once) == listed(plain)


def test_gates_read_scores_once(spark, candidates):
    rows, _ = candidates
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def logit(y):
        seen.add(1)
        return 2.0 * y - 1

    assert pair_encoder.gates(rows.withColumn("ce_logit", logit("y")).withColumn("prob", F.lit(0.5))).count() == 3
    assert seen.value == 160


def test_stored_records_are_not_broadcast_to_pairs(spark, sf):
    from linkwright.operators import pair_features
    from linkwright.queries import raw

    records = stage(raw.normal_records(spark, sf), "raw-records")
    pairs = stage(records.select(F.col("rid").alias("q"), (F.col("rid") + 1).alias("p"), F.lit(0.9).alias("prob")), "pairs")
    texts = records.select("rid", F.col("n_core").alias("text"))
    for df in (pair_features.pair_features(pairs, records), pair_features.number_features(pairs, records), models.second_scores(pairs.withColumn("half", F.lit("A")), texts, {"A": len})):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_link_stores_no_texts_that_no_channel_reads(spark, monkeypatch):
    records = spark.createDataFrame([(1, "us", True, 1, "red fox", "12 main st"), (2, "us", False, 2, "red fox", "12 main st"), (3, "us", False, 2, "blue owl", "")], "rid long, country string, is_query boolean, src int, name string, address string")
    stored = {}
    monkeypatch.setattr(linkage, "stage", lambda df, name: stored.setdefault(name, df.columns) and stage(df, name))
    sets = linkage.link(records, {"name": Channel({"name": 1.0}, 3)}, lambda x: x.select("q", "p")).collect()
    assert [(r.q, list(r.ps)) for r in sets] == [(1, [2])]
    assert set(stored["normal"]) == {"rid", "country", "is_query", *blocking.INPUT["name"]}


def test_pairs_are_described_by_slices(spark, sf, monkeypatch):
    """No row for a token of a pair; slices give what one pass gives, and the features are stored once more only."""
    from linkwright.operators import pair_features
    from linkwright.queries.suites import _raw_pairs

    normal, pairs = _raw_pairs(spark, sf)
    pairs = stage(pairs.withColumn("s", F.pmod(F.col("q") * F.col("p"), F.lit(7)) / 7.0).withColumns({"y": F.lit(1), "fold": F.pmod("q", F.lit(5)).cast("int")}), "pairs")
    weighed = pair_features.weighted_overlap(pairs, normal, "n_core", pair_features.country_idf(normal, "n_core"), soft=True)
    assert "Generate" not in weighed._jdf.queryExecution().executedPlan().toString()
    listed = lambda df: sorted(tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in df.collect())
    whole = listed(linkage.describe(pairs, normal, ["s"]))
    monkeypatch.setattr(linkage, "SLICE", 1 + len(whole) // 3)
    described = linkage.describe(pairs, normal, ["s"])
    assert listed(described) == whole and len(whole) == pairs.count() > 20
    stored = {}
    monkeypatch.setattr(linkage, "stage", lambda df, name: stored.setdefault(name, df.columns) and stage(df, name))

    class Even:
        def fit(self, rows, features):
            assert "q" not in features and len(features) > 70
            return lambda df: df.withColumn("prob", F.lit(0.5))

    assert linkage.matcher(described, normal, Even(), Even()).count() == len(whole)
    assert stored["staged"] == ["q", "p", "prob"]
