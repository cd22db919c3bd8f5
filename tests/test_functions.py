"""Golden cases of normalisation, kernels, numbers and hashing."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkwright.functions import addresses, arrays, hashing, kernels, names, numbers, script
from linkwright.functions.learned import dictionary, learn_tokens
from linkwright.operators.evaluate import poisson_weights


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text,latin", [("एलएलपी", "elelapi"), ("प्राइवेट", "praivet"), ("लिमिटेड", "limited"), ("plain", "plain"), ("मित्र", "mitra"), ("१२", "12")])
def test_transliteration(text, latin):
    assert script.transliterate(text) == latin


@pytest.mark.parametrize("token,letters", [("elelpi", "llp"), ("eses", "ss"), ("elelapi", "llp"), ("ab", None), ("house", None), ("el", None), ("e" * 25, None)])
def test_spelled_acronyms(token, letters):
    assert script.spelled_acronym(token) == letters


def test_fold_takes_both_ways_to_the_same_text(spark):
    for text in ("  Mixed   CASE\ttext ", "Café Ünïcode", "Straße", "ﬁne", "", "日本 x", "a\x1cb"):
        assert one(spark, text, script.fold) == script.fold_text(text)
    assert one(spark, None, script.fold) == ""


NAMES = [
    ("The Dent Tattoo", {"n_core": "dent tattoo", "n_cons": "the dent tattoo"}),
    ("L.L.C. Foo", {"n_legal": "llc", "n_core": "foo"}),
    ("maurewilliamscolombier.com", {"n_core": "maurewilliamscolombier", "n_is_domain": 1}),
    ("https://www.foo-bar.co.uk/", {"n_core": "foo bar", "n_is_domain": 1}),
    ("5even ne0tech fami1y 1st 24x7 7eleven", {"n_cons": "seven neotech family lst 24x7 televen"}),
    ("phone ventures bag", {"n_skel": "fn vntrs pk"}),
    ("Straße", {"n_core": "stra e"}),
    ("Acme d.b.a. Zeta #12 +1 555-123-4567", {"n_has_dba": 1, "n_has_phone": 1, "n_core": "acme zeta"}),
    ("प्राइवेट लिमिटेड एलएलपी", {"n_legal": "llp ltd pvt", "n_indic": 1}),
    ("Praivet Limited Incorporated", {"n_legal": "inc ltd pvt"}),
    ("Inc 42", {"n_core": "inc", "n_digits": "42"}),
    ("www.com", {"n_cons": "www"}),
    (None, {"n_core": "", "n_cons": "", "n_compact": ""}),
]


def test_names(spark):
    rows = names.name_columns(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, raw string"), "raw").collect()
    for r in rows:
        for column, value in NAMES[r.i][1].items():
            assert r[column] == value, (r.raw, column)


def test_learned_tokens_replace_first(spark):
    raw = spark.createDataFrame([("राम", )], "raw string")
    token = names.name_columns(raw, "raw").first().n_cons
    assert names.name_columns(raw, "raw", {token: "ramesh"}).first().n_cons == "ramesh"


ADDRESSES = [
    ("Tenth 10th", {"a_nums": "10 10"}), ("45ND", {"a_norm": "45"}), ("1056c", {"a_norm": "1056 c"}), ("AF-0684", {"a_norm": "af 684"}), ("Af-684", {"a_norm": "af 684"}), ("<NULL>, N/A", {"a_empty": 1}),
    ("Street Saint St", {"a_norm": "st st st"}), ("R. BD.", {"a_norm": "rue blvd"}), ("12 bis", {"a_norm": "12 bis"}), ("02139", {"a_norm": "2139", "a_pin": ""}), ("1 Main Rd, Town, 60614", {"a_pin": "60614", "a_ncomp": 3, "a_first_num": "1"}),
    ("000", {"a_norm": "0"}), (None, {"a_empty": 1, "a_ncomp": 0}), ("abcdefghijklm1", {"a_norm": "abcdefghijklm1"}),
]


def test_addresses(spark):
    rows = addresses.address_columns(spark.createDataFrame([(i, n) for i, (n, _) in enumerate(ADDRESSES)], "i int, raw string"), "raw").collect()
    for r in rows:
        for column, value in ADDRESSES[r.i][1].items():
            assert r[column] == value, (r.raw, column)


def test_skeleton_against_a_loop(spark):
    from linkwright.functions import vocabulary as V

    def loop(t):
        for a, b in V.SKELETON:
            t = t.replace(a, b)
        t = t.translate(str.maketrans(V.SOUND_FROM, V.SOUND_TO))
        return re.sub(r"(.)\1+", r"\1", t[:1] + re.sub("[aeiou]+", "", t[1:]))

    rng = random.Random(1)
    tokens = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    for r in spark.createDataFrame([(t,) for t in tokens], "t string").select("t", names.skeleton(F.col("t")).alias("s")).collect():
        assert r.s == loop(r.t)


def test_initials_against_a_callback(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab. c") for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    loop = lambda s: re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group(1).replace(".", ""), s)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.join_initials(F.col("t")).alias("s")).collect():
        assert r.s == loop(r.t), r.t


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[-1], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_kernels():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert kernels.lcs_length(a, b) == lcs(a, b)
        for f in kernels.KERNELS.values():
            assert 0 <= f(a, b) <= 100 + 1e-9 and abs(f(a, b) - f(b, a)) < 1e-9
    assert abs(kernels.ratio("kitten", "sitting") - 61.538461) < 1e-5 and kernels.ratio("", "") == 100
    assert kernels.token_sort_ratio("b a", "a b") == 100 and kernels.token_set_ratio("a b c", "a b") == 100
    assert kernels.token_set_ratio("", "a") == 0 and kernels.partial_ratio("abcd", "XXabcdYY") == 100
    assert abs(kernels.jaro_winkler("martha", "marhta") - 0.961111) < 1e-5 and kernels.jaro_winkler("", "") == 1


def test_similarity_column(spark):
    df = spark.createDataFrame([("ab", "ab"), ("ab", None), ("", "x")], "a string, b string")
    assert [r.s for r in df.select(kernels.similarity("ratio", F.col("a"), F.col("b")).alias("s")).collect()] == [100.0, None, 0.0]
    assert [r.s for r in df.na.fill("").select(kernels.levenshtein_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, 0.0, 0.0]


def test_number_relations(spark):
    cases = {("30", "32"): (0, math.log(3), 1, 1, 1, 0, 0, 1), ("1325", "6325"): (0, math.log(5001), 1, 1, 1, 0, 0, 0), ("123", "12"): (0, math.log(112), 0, 0, 0, 0, 1, 0), ("12", "21"): (0, math.log(10), 0, 1, 0, 1, 0, 1), ("7", "7"): (1, 0, 1, 1, 0, 0, 0, 0), ("", "5"): (-1,) * 8, ("9" * 30, "1"): (0, math.log(10**30 - 1), 1, 0, 0, 0, 0, 0)}
    street = F.array(F.lit("main"))
    df = spark.createDataFrame(list(cases), "a string, b string")
    for r in df.select("a", "b", *[v.alias(k) for k, v in numbers.number_relations(F.col("a"), F.col("b"), street, street, F.array("b")).items()]).collect():
        assert [r[n] for n in numbers.NAMES[:8]] == pytest.approx(cases[r.a, r.b], abs=1e-9), (r.a, r.b)


def test_three_state_sets(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"]), (["a", "a"], ["a"])], "x array<string>, y array<string>")
    got = df.select(arrays.jaccard(F.col("x"), F.col("y")).alias("j"), arrays.containment(F.col("x"), F.col("y")).alias("c")).collect()
    assert [r.j for r in got] == pytest.approx([-1, 0, 1 / 3, 1]) and [r.c for r in got] == pytest.approx([-1, -1, 0.5, 1])


def test_hash_folds(spark):
    ids = [f"S1-{i}" for i in range(500)]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", hashing.fold_of(F.col("id")).alias("f"), hashing.dropped(F.col("id"), 0.3, "drop").alias("d"))
    for r in df.collect():
        assert r.f == int(hashlib.md5(r.id.encode()).hexdigest(), 16) % 5
        assert r.d == (int(hashlib.md5(f"{r.id}|drop".encode()).hexdigest(), 16) % 10000 < 3000)


def test_learned_dictionary(spark):
    pairs = [("Ramesh Traders", "रमेश ट्रेडर्स")] * 4 + [("Other Name", "plain latin")] * 5 + [("राम", "रमेश")]
    found = {r.token: r.target for r in learn_tokens(spark.createDataFrame(pairs, "latin string, other string")).collect()}
    assert "traders" in found.values() or "ramesh" in found.values()
    assert learn_tokens(spark.createDataFrame(pairs[:1], "latin string, other string")).count() == 0


def test_dictionary_is_bounded(spark):
    learned = spark.createDataFrame([("a", "x"), ("b", "y")], "token string, target string")
    assert dictionary(learned) == {"a": "x", "b": "y"}
    with pytest.raises(ValueError):
        dictionary(learned, 1)


def test_poisson_weights():
    w = poisson_weights(np.arange(400, dtype=np.uint64) * np.uint64(7919), 300)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[:200].ravel(), w[200:].ravel())[0, 1]) < 0.02
