"""Decisions, context, evaluation, shift, simulation, retrieval and models: golden cases and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright import catalog
from linkwright.config import Channel, EngineConfig
from linkwright.operators import blocking, context, decision, evaluate, models, pair_features, sampling, shift, simulate
from linkwright.plans import linkage
from linkwright.sources import readers, sinks
from linkwright.streaming import incremental

PAIRS = "q long, p long, prob double, y int"


def pairs_of(spark, rows):
    return spark.createDataFrame([(*r, 0)[:4] for r in rows], PAIRS)


def qp(df):
    return sorted((r.q, r.p) for r in df.collect())


def random_pairs(spark, seed=0, n=600):
    rng = random.Random(seed)
    own = {(rng.randrange(40), rng.randrange(60)): round(rng.random(), 3) for _ in range(n)}
    return spark.createDataFrame([(q, p, v, int(v > 0.6)) for (q, p), v in own.items()], PAIRS), own


def test_exclusive_keeps_ties(spark):
    assert qp(decision.exclusive(pairs_of(spark, [(1, 1, 0.9), (2, 1, 0.8)]))) == [(1, 1)]
    assert qp(decision.exclusive(pairs_of(spark, [(1, 1, 0.9), (2, 1, 0.9)]))) == [(1, 1), (2, 1)]


def test_expected_f_golden(spark):
    assert qp(decision.expected_f_policy(pairs_of(spark, [(1, 1, 0.9), (1, 2, 0.6), (1, 3, 0.05)]), 0.3)) == [(1, 1)]
    assert qp(decision.expected_f_policy(pairs_of(spark, [(1, 1, 0.3)]))) == []
    assert qp(decision.gated_expected_f_policy(pairs_of(spark, [(1, 1, 0.55)]))) == []


def test_expected_f_against_a_loop(spark):
    df, own = random_pairs(spark)
    best = {}
    for (_, p), v in own.items():
        best[p] = max(best.get(p, 0), v)
    expected = []
    for q in {q for q, _ in own}:
        mine = sorted(((v, -p) for (a, p), v in own.items() if a == q and v >= 0.05 and v >= best[p]), reverse=True)
        total, hits, top, k_best = sum(v for v, _ in mine), 0.0, -1.0, 0
        for k, (v, _) in enumerate(mine, 1):
            hits += v
            if 1.25 * hits / (k + 0.25 * (total + 0.3)) > top + 1e-12:
                top, k_best = 1.25 * hits / (k + 0.25 * (total + 0.3)), k
        if mine and top > math.prod(1 - min(v, 1 - 1e-9) for v, _ in mine):
            expected += [(q, -p) for _, p in mine[:k_best]]
    assert qp(decision.expected_f_policy(df, 0.3)) == sorted(expected)


def test_policies_claim_once(spark):
    df, _ = random_pairs(spark, 1)
    df = df.withColumn("num_agree", F.col("y"))
    for name, policy in decision.policies().items():
        chosen = policy(df)
        assert chosen.join(df, ["q", "p"], "left_anti").count() == 0
        if name != "thr0.5_shared":
            clashes = chosen.groupBy("p").agg(F.count("*").alias("n"), F.countDistinct("prob").alias("v")).where("n > 1 AND v > 1")
            assert clashes.count() == 0
    assert decision.conditional_policy(df).count() > 0


def test_sets_include_empty_ones(spark):
    queries = spark.createDataFrame([(1,), (2,)], "q long")
    found = {r.q: r.ps for r in decision.to_sets(pairs_of(spark, [(1, 9, 1.0), (1, 3, 1.0), (7, 1, 1.0)]), queries).collect()}
    assert found == {1: [3, 9], 2: []}


def test_other_best(spark):
    rows = context.profile_features(pairs_of(spark, [(1, 1, 0.9), (2, 1, 0.7), (3, 1, 0.2), (1, 2, 0.5)])).collect()
    assert {(r.q, r.p): r.other_best_p for r in rows} == {(1, 1): 0.7, (2, 1): 0.9, (3, 1): 0.9, (1, 2): -1.0}


def test_ranks_are_permutations(spark):
    df, own = random_pairs(spark, 2)
    rows = context.context_features(df, ["prob"]).collect()
    by_q = {}
    for r in rows:
        by_q.setdefault(r.q, []).append(r.prob_rank_q)
        assert r.prob_gap_q >= 0 and r.prob_gap_p >= 0
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_q.values())


def test_siblings_leave_self_out_after_the_cut(spark):
    df = pairs_of(spark, [(1, p, 0.95 - p / 100) for p in range(8)] + [(2, 1, 0.6)])
    found = context.siblings(df).groupBy("q", "p").count().collect()
    assert {(r.q, r.p): r["count"] for r in found} == {(1, p): 5 if p < 6 else 6 for p in range(8)}
    records = spark.createDataFrame([(p, f"n{p % 2}", "a" if p else "", str(p % 3), p % 2) for p in range(8)], "rid long, name string, addr string, first_num string, src long")
    same = lambda a, b: F.when(a == b, 100.0).otherwise(0.0)
    got = {(r.q, r.p): r for r in context.sibling_support(df, records, same, same).collect()}
    assert got[2, 1].n_sibs == 0 and got[2, 1].sib_name_max == -1 and got[1, 0].sib_addr_max == -1 and got[1, 7].n_sibs == 6


def test_f05(spark):
    truth, pred, queries = [(1, 1), (1, 2), (3, 5)], [(1, 1), (2, 4)], [(1,), (2,), (3,), (4,)]
    mk = lambda rows: spark.createDataFrame(rows, "q long, p long")
    rows = {r.q: r.f for r in evaluate.per_query(mk(pred), mk(truth), spark.createDataFrame(queries, "q long")).collect()}
    assert rows == pytest.approx({1: 0.833333, 2: 0.0, 3: 0.0, 4: 1.0}, abs=1e-5)


def test_bootstrap_covers_the_mean(spark):
    a = spark.range(400).select(F.col("id").alias("q"), F.lit(0.5).alias("f"))
    b = a.withColumn("f", 0.5 + (F.col("q") % 10) / 100)
    r = evaluate.bootstrap(a, b, 100).first()
    assert r.low < r.mean_diff < r.high and r.high - r.low < 0.02


def test_calibration_of_perfect_probabilities(spark):
    df = spark.range(1000).select((F.col("id") % 10 == 0).cast("int").alias("y"), F.lit(0.1).alias("prob"))
    assert evaluate.calibration_error(df).first().ece == pytest.approx(0, abs=1e-9)


def test_em_finds_the_prior(spark):
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.15
    x = rng.normal(np.where(y, 1.0, -1.0))
    train = 0.5
    p = 1 / (1 + np.exp(-2 * x - math.log(train / (1 - train))))
    df = spark.createDataFrame([(float(v), "g") for v in p], "prob double, grp string")
    assert shift.em_prior(df, "grp", train).first().prior == pytest.approx(0.15, abs=0.02)


def test_perturbed_copies_are_deterministic(spark):
    records = spark.createDataFrame([(str(i), f"north bay trading {i % 7}", f"{i} main st") for i in range(400)], "entity_id string, name string, address string")
    a = simulate.perturbed_copies(records, ["north", "and sons"])
    assert sorted(a.collect()) == sorted(simulate.perturbed_copies(records.repartition(7), ["north", "and sons"]).collect())
    moved = a.join(records.select("entity_id", F.col("address").alias("old")), a.source_id == F.col("entity_id"))
    gaps = [abs(int(r.address.split()[0]) - int(r.old.split()[0])) for r in moved.collect()]
    assert 0.45 < len(gaps) / 400 < 0.75 and max(gaps) <= 12 and np.mean(np.array(gaps) > 0) > 0.8


def test_samples(spark):
    df, own = random_pairs(spark, 3)
    kept = sampling.keep_groups(df, "q", 0.5)
    assert kept.select("q").distinct().join(df, "q").count() == kept.count()
    assert sampling.first_by_hash(df, ["q", "p"], 50).count() == 50
    labels = {(r.q, r.p): r.pseudo for r in sampling.pseudo_labels(pairs_of(spark, [(1, 1, 0.98), (2, 1, 0.97), (3, 1, 0.02), (4, 1, 0.5)])).collect()}
    assert labels == {(1, 1): 1, (2, 1): -1, (3, 1): 0, (4, 1): -1}


RECORDS = [
    (1, "US", True, 1, "Blue Ocean Trading LLC", "12 Main Street, Springfield 12345"), (2, "US", True, 1, "Acme Rockets Inc", "99 Desert Road, Tucson"), (3, "IN", True, 1, "Sharma Sweets Pvt Ltd", "4 Gandhi Nagar, Pune 411001"),
    (11, "US", False, 2, "blue ocean tradng", "12 Main St Springfield"), (12, "US", False, 3, "ACME ROCKETS", "99 desert rd tucson"), (13, "US", False, 2, "Quiet Lake Cafe", "5 Elm Street"), (14, "IN", False, 3, "Sharma Sweets", "4 gandhi nagar pune"), (15, "IN", False, 2, "Blue Ocean Trading", "12 Main St"),
]
CHANNELS = {"name": Channel({"name": 1.0}, 5), "combo": Channel({"name": 0.5, "addr": 0.5}, 5), "gram": Channel({"gram": 1.0}, 5), "conj": Channel({"conj": 0.6, "name": 0.2, "addr": 0.2}, 5)}


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, "rid long, country string, is_query boolean, src int, name string, address string")


def test_linkage_finds_planted_matches_within_countries(spark, records):
    sets = {r.q: r.ps for r in linkage.link(records, CHANNELS, lambda x: decision.threshold_policy(x, 0.4)).collect()}
    assert sets == {1: [11], 2: [12], 3: [14]}


def test_retrieval_plan_has_no_cartesian_product(spark, records):
    plan = blocking.candidates(linkage.normalise(records), CHANNELS)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    top = blocking.top_k(random_pairs(spark)[0], "prob", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top


def test_copies_are_retrieved_by_class(spark, monkeypatch):
    """Many records of few names: pairs of classes are scored, and every query gets the records with the smallest keys."""
    names = ["river stone", "river gate", "silver stone", "maple gate"]
    own = spark.createDataFrame([(i, "US", i % 5 == 0, names[i % 4], names[i % 4].replace(" ", ""), "", "") for i in range(400)], "rid long, country string, is_query boolean, n_core string, n_compact string, n_skel string, n_cons string")
    seen, dots = [], blocking.dot_products
    monkeypatch.setattr(blocking, "dot_products", lambda weights, bases: seen.append(weights) or dots(weights, bases))
    found = {}
    for r in blocking.candidates(own, {"gram": Channel({"gram": 1.0}, 3)}).collect():
        found.setdefault(r.q, {})[r.p] = r.s_gram
    plain = dots(blocking.tfidf(blocking.long_features(own, ["gram"]), own), ["gram"]).select("q", "p", F.round("d_gram", 9).alias("s"))
    expected = {}
    for r in blocking.top_k(plain, "s", 3).collect():
        expected.setdefault(r.q, {})[r.p] = r.s
    assert found == expected and len(found) == 80
    assert seen[0].select("rid").distinct().count() == 8  # four names on two sides


@pytest.mark.parametrize("weights", [1 << 20, 300])
def test_blocks_in_memory_find_what_the_join_finds(spark, sf, monkeypatch, weights):
    """Many products are summed by blocks, and no pair but the first of a block is written; ties, asked queries and all channels included."""
    from linkwright.queries.texts import _records

    own = _records(spark, sf).where("rid < 400")
    channels = {"name": Channel({"name": 1.0}, 3), "combo": Channel({"name": 0.5, "addr": 0.5}, 4), "gram": Channel({"gram": 1.0}, 1000)}
    listed = lambda **more: sorted(tuple(round(x, 8) for x in r) for r in blocking.candidates(own, channels, **more).collect())
    plain, some = listed(), listed(asked=F.col("rid") < 100)
    monkeypatch.setattr(blocking, "FEW_PRODUCTS", 0)
    monkeypatch.setattr(blocking, "BLOCK_WEIGHTS", weights)
    monkeypatch.setattr(blocking, "CELLS", 64)
    monkeypatch.setattr(blocking, "dot_products", None)  # the join of all products
    assert listed() == plain and listed(asked=F.col("rid") < 100) == some and 0 < len(some) < len(plain)


@pytest.mark.parametrize("name, scorer", [("rescore_pairs", (blocking, "rescore")), ("weighted_jaccard", (pair_features, "weighted_overlap")), ("soft_tfidf", (pair_features, "weighted_overlap")), ("visible_weights", (pair_features, "weighted_overlap"))])
def test_copies_of_records_are_scored_once(spark, sf, tmp_path, monkeypatch, name, scorer):
    """Parts that differ by key alone add pairs to the result, but none that has to be scored."""
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey < 60")
    copies = part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 99 * 1000))  # of the same forms of raw names and addresses
    spark.read.parquet(f"{sf}/customer.parquet").limit(0).write.parquet(f"{tmp_path}/customer.parquet")
    seen, own = [], getattr(*scorer)
    monkeypatch.setattr(*scorer, lambda pairs, *a, **b: seen.append(pairs.count()) or own(pairs, *a, **b))
    sizes = []
    copies.write.parquet(f"{tmp_path}/part.parquet")
    sizes.append(catalog.queries()[name](spark, str(tmp_path)).count())
    assert seen[0] * 4 <= sizes[0] and sizes[0] > 0


@pytest.mark.parametrize("clashes", [0, 1])
def test_no_row_for_a_feature_is_dealt_out(spark, sf, monkeypatch, clashes):
    """Blocks count and weigh features in packed lists; where two features have one hash, another seed is taken."""
    from linkwright.queries.texts import _records

    own, channels = _records(spark, sf).where("rid < 200"), {"name": Channel({"name": 1.0}, 3), "mix": Channel({"gram": 0.5, "addr": 0.5}, 3)}
    listed = lambda: sorted(tuple(round(x, 8) for x in r) for r in blocking.candidates(own, channels).collect())
    plain, hashed, seeds = listed(), blocking.hashed_features, []

    def coarse(records, bases, seed):
        seeds.append(seed)
        rows = hashed(records, bases, seed)
        return rows.withColumn("h", F.transform("h", lambda h: F.pmod(h, F.lit(97)))) if seed < clashes else rows

    monkeypatch.setattr(blocking, "FEW_PRODUCTS", 0)
    monkeypatch.setattr(blocking, "long_features", None)  # a row for each feature of each record
    monkeypatch.setattr(blocking, "hashed_features", coarse)
    assert listed() == plain and set(seeds) == set(range(clashes + 1))


def test_parts_of_an_address_are_in_the_whole(spark):
    from linkwright.functions.addresses import address_columns, address_parts

    raw = ["", "12b Rue de la Paix, 007", "n/a, Near Market Road", "Twelfth Floor, Block c7 & North", "Château d'Or,, PO Box 42", "the of la", None]
    own = address_columns(spark.createDataFrame([(x,) for x in raw], "raw string"), "raw").select("a_norm", "a_words", "a_nums")
    assert own.withColumns(address_parts()).collect() == own.collect()


def test_retrieval_against_a_loop(spark, records):
    normal = linkage.normalise(records)
    dots = {(r.q, r.p): r.d_gram for r in blocking.dot_products(blocking.tfidf(blocking.long_features(normal, ["gram"]), normal), ["gram"]).collect()}
    rows = {r.rid: r for r in normal.collect()}
    grams = {i: {f"^{r.n_compact}$"[k : k + 4] for k in range(max(1, len(r.n_compact) - 1))} for i, r in rows.items()}
    for country in ("US", "IN"):
        own = [i for i, r in rows.items() if r.country == country]
        df = {}
        for i in own:
            for g in grams[i]:
                df[g] = df.get(g, 0) + 1
        w = {i: {g: math.log(len(own) / df[g]) for g in grams[i] if df[g] >= 2} for i in own}
        norm = {i: math.sqrt(sum(x * x for x in w[i].values())) for i in own}
        for q in own:
            for p in own:
                if rows[q].is_query and not rows[p].is_query:
                    dot = sum(w[q][g] * w[p][g] for g in w[q].keys() & w[p].keys())
                    assert dots.get((q, p), 0.0) == pytest.approx(dot / (norm[q] * norm[p]) if dot else 0.0, abs=1e-9)
    with pytest.raises(ValueError):
        blocking.features(normal, "nothing")


def test_all_features_are_there(spark, records):
    normal = linkage.normalise(records).cache()  # stage tables on a cluster
    pairs = linkage.retrieve(normal, CHANNELS).cache()
    wide = linkage.describe(pairs, normal, [f"s_{n}" for n in CHANNELS])
    rows = {(r.q, r.p): r for r in wide.collect()}
    r = rows[2, 12]
    assert r.n_tset == 100 and r.a_tset == 100 and r.n_jacc == 1 and r.num_state == 1 and r.a_num_best_sim == 100 and r.idf_n_wjacc == 1
    assert rows[1, 11].n_jw_compact > 0.9 and rows[1, 11].idf_n_soft > 0.5
    assert len(pair_features.set_features() | pair_features.name_kernels() | pair_features.address_features()) + 1 == 38
    assert all(v is not None for row in rows.values() for v in row)
    misses = blocking.misses(spark.createDataFrame([(1, 15), (1, 11)], "q long, p long"), pairs, normal).first()
    assert misses.missed == 1 and misses.name0 == 0


def test_out_of_fold_never_sees_its_fold(spark):
    rows = spark.range(300).select((F.col("id") % 50).alias("q"), F.col("id").alias("p"), (F.col("id") % 7 / 7.0).alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("fold"))
    seen = []

    class Spy:
        def fit(self, own, features):
            seen.append({r.fold for r in own.select("fold").distinct().collect()})
            return lambda df: df.withColumn("prob", F.lit(0.5))

    out = models.out_of_fold(rows, ["x"], Spy())
    assert out.count() == 300 and seen == [{1, 2, 3, 4} - {k} for k in (1, 2, 3, 4)]
    real = models.out_of_fold(rows, ["x"], models.gbt(3, 2))
    assert evaluate.auc(real).first().auc > 0.99
    assert evaluate.auc(models.leave_group_out(rows, "fold", 1, ["x"], models.logistic()).withColumn("prob", F.round("prob", 4))).first().auc > 0.99


def test_model_tools(spark):
    rows = spark.range(400).select(F.col("id").alias("q"), F.col("id").alias("p"), (F.col("id") % 10 / 10.0).alias("x"), (F.col("id") % 10 > 5).cast("int").alias("y"))
    fitted = models.logistic().fit(rows, ["x"])
    assert models.is_monotone(models.partial_dependence(rows, fitted, "x", [0.1, 0.5, 0.9])).first().rises
    assert models.importance(fitted, ["x"])[0][0] == "x"
    scored = fitted(rows)
    assert models.ks_distance(scored, scored).first().ks == 0
    assert models.adapt(rows, scored, ["x"], models.logistic()).count() == 400
    halves = {r.h for r in rows.select(models.cross_fit_half(F.lit(1), F.col("q")).alias("h")).collect()}
    assert halves == {"B"}
    texts = rows.select(F.col("q").alias("rid"), F.lit("a b").alias("text"))
    pairs = rows.select("q", "p", F.lit("A").alias("half"))
    assert {r.ce_logit for r in models.second_scores(pairs, texts, {"A": lambda own: [1.5] * len(own)}).collect()} == {1.5}
    assert rows.select(models.logit(F.lit(0.5)).alias("l")).first().l == 0


def test_tsv_round_trip(spark, tmp_path):
    config = EngineConfig(data=str(tmp_path))
    rows = ['S1-1\tA "quoted" name\t1 \\ road\tUS', "S1-2\tNULL\t\tUS", "S1-3\t N/A\tNaN\tFR"]
    for k in (1, 2, 3):
        (tmp_path / f"train_source{k}.tsv").write_text("entity_id\tname\taddress\tcountry\n" + "\n".join(r.replace("S1", f"S{k}") for r in rows) + "\n")
    (tmp_path / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    split = readers.read_split(spark, config, "train")
    own = {r.entity_id: r for r in split.collect()}
    assert len(own) == 9 and own["S1-1"].business_name == 'A "quoted" name' and own["S2-1"].src == 2
    assert own["S1-2"].business_address == "" and own["S1-2"].business_name == "NULL" and own["S1-3"].business_name.strip() == "N/A"
    truth = readers.read_truth(spark, config)
    assert {r.q_id: r.p_ids for r in truth.collect()} == {"S1-1": ["S2-1", "S3-1"], "S1-2": []}
    queries = spark.createDataFrame([(0, "S1-2"), (1, "S1-1")], "position int, q_id string")
    sets = sinks.set_rows(readers.truth_pairs(truth), queries)
    sinks.write_sets(sets, str(tmp_path / "out"), "matched_entity_ids")
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS2-1,S3-1\n"
    pool = split.where("src > 1").select(F.col("entity_id").alias("p_id"))
    assert {r.violations for r in sinks.contract(sets, sets, queries, pool).collect()} == {0}
    bad = {r.rule for r in sinks.contract(sets.withColumn("ids", F.lit("S9-9,S9-9")), sets, queries, pool).where("violations > 0").collect()}
    assert bad == {"match: id twice", "match: id not in the pool", "match: not among the candidates"}


def test_stage_tables_and_logs(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "t"), build).count() == 3
    assert len(built) == 1 and readers.column_names(spark, str(tmp_path / "t")) == ["id"]
    for i, tag in enumerate(("a", "b", "a")):
        sinks.append_record(spark, {"tag": tag, "seq": i, "extra": {"n": i}}, str(tmp_path / "log"))
    log = spark.read.schema("tag string, seq long").json(str(tmp_path / "log"))
    assert {r.tag: r.seq for r in readers.last_record(log, "tag", "seq").collect()} == {"a": 2, "b": 1}


def test_incremental_claims(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "claims")
    batches = [[(1, 1, 0.95), (2, 2, 0.91)], [(3, 1, 0.97), (4, 2, 0.5)], [(5, 9, 0.99)]]
    for rows in batches:
        spark.createDataFrame(rows, "q long, p long, prob double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("q long, p long, prob double").parquet(source)
        incremental.keep_claims(stream, path, str(tmp_path / "ck")).awaitTermination(60)
    assert qp(incremental.current(spark, path)) == [(2, 2), (3, 1), (5, 9)]
