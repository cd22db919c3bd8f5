"""Evaluation of match sets: macro F0.5 with empty sets as answers, reports, calibration, bootstrap, run comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1 if both sets are empty, 0 if nothing is shared, else F0.5."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def per_query(predicted: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, n_pred, n_true, tp, f, prec, rec) of every query; ``predicted(q, p)``, ``truth(q, p)``."""
    both = predicted.select("q", "p").distinct().withColumn("a", F.lit(1)).join(truth.select("q", "p").distinct().withColumn("b", F.lit(1)), ["q", "p"], "full")
    sums = both.groupBy("q").agg(F.count("a").alias("n_pred"), F.count("b").alias("n_true"), F.count(F.col("a") + F.col("b")).alias("tp"))
    out = queries.join(sums, "q", "left").na.fill(0, ["n_pred", "n_true", "tp"])
    tp, p, t = F.col("tp"), F.col("n_pred"), F.col("n_true")
    return out.withColumns({
        "f": f05(tp, p, t),
        "prec": F.when(p > 0, tp / p).otherwise((t == 0).cast("double")),
        "rec": F.when(t > 0, tp / t).otherwise(1.0),
    })


def report(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro averages and counts over the rows of ``per_query``, for all or by group."""
    single = F.col("n_true") == 0
    return scores.groupBy(*(by or [])).agg(
        F.count("*").alias("n_queries"), F.avg("f").alias("macro_f05"), F.avg("prec").alias("precision"), F.avg("rec").alias("recall"),
        F.avg(F.when(single, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"), F.avg(F.when(~single, F.col("f"))).alias("nonsingleton_f05"),
        F.sum(F.col("n_pred") - F.col("tp")).alias("false_merges"), F.sum(F.col("n_true") - F.col("tp")).alias("missed"),
        F.avg(((F.col("n_pred") == F.col("tp")) & (F.col("n_true") == F.col("tp"))).cast("double")).alias("exact_sets"),
    )


def candidate_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    hit = truth.select("q", "p").distinct().join(candidates.select("q", "p").distinct().withColumn("c", F.lit(1)), ["q", "p"], "left")
    return hit.agg((F.count("c") / F.count("*")).alias("candidate_recall"))


def fold_report(scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the folds' macro F0.5."""
    return scores.groupBy("fold").agg(F.avg("f").alias("f")).agg(F.avg("f").alias("mean_f05"), F.stddev_pop("f").alias("std_f05"))


def poisson_weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """(keys, replicates): Poisson(1) weights from a mixed hash of each key (as unsigned longs) and replicate."""
    with np.errstate(over="ignore"):
        x = keys[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ x >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), u).astype(float)


def bootstrap(before: DataFrame, after: DataFrame, replicates: int = 1000) -> DataFrame:
    """Mean difference of two runs' per-query scores and its 95 % interval, by Poisson weights from hashes of (query, replicate).

    Each task sums the weights of its queries over all replicates at once and returns one row a replicate.
    """
    d = before.select("q", F.col("f").alias("f0")).join(after.select("q", F.col("f").alias("f1")), "q").select(F.xxhash64("q").alias("key"), (F.col("f1") - F.col("f0")).alias("d"))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(replicates), np.zeros(replicates)
        for pdf in frames:
            keys, own = pdf["key"].to_numpy().view(np.uint64), pdf["d"].to_numpy()
            for i in range(0, len(own), 1024):
                w = poisson_weights(keys[i : i + 1024], replicates)
                total += own[i : i + 1024] @ w
                weight += w.sum(0)
        yield pd.DataFrame({"rep": np.arange(replicates), "wd": total, "w": weight})

    means = d.mapInPandas(sums, "rep int, wd double, w double").groupBy("rep").agg((F.sum("wd") / F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return d.agg(F.avg("d").alias("mean_diff")).crossJoin(F.broadcast(interval))  # one row each


def oracle_losses(pairs: DataFrame, selected: DataFrame, truth: DataFrame, owners: DataFrame, queries: DataFrame) -> DataFrame:
    """(variant, macro_f05): what perfect decisions of one kind would be worth.

    ``perfect`` classifies the candidates without error; the others drop selected pairs of unowned records or of records of
    another query, or add true pairs that were candidates or that weren't.
    """
    own = truth.select("q", "p").distinct()
    chosen = selected.select("q", "p").distinct()
    cand = pairs.select("q", "p").distinct()
    wrong = chosen.join(own, ["q", "p"], "left_anti")
    owned = owners.select("p").distinct()
    variants = {
        "as_is": chosen,
        "perfect": cand.join(own, ["q", "p"], "left_semi"),
        "drop_unowned": chosen.join(wrong.join(owned, "p", "left_anti"), ["q", "p"], "left_anti"),
        "drop_owned": chosen.join(wrong.join(owned, "p", "left_semi"), ["q", "p"], "left_anti"),
        "add_candidates": chosen.unionByName(cand.join(own, ["q", "p"], "left_semi")).distinct(),
        "add_unretrieved": chosen.unionByName(own.join(cand, ["q", "p"], "left_anti")).distinct(),
    }
    rows = [per_query(v, own, queries).agg(F.avg("f").alias("macro_f05")).select(F.lit(k).alias("variant"), "macro_f05") for k, v in variants.items()]
    return reduce(DataFrame.unionByName, rows)


def cascade(rules: list[tuple[str, Column]], otherwise: str = "other") -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def error_type() -> Column:
    """The likely reason for an error in a pair with features."""
    c = F.col
    return cascade([
        ("missing address", c("p_a_empty") == 1),
        ("same name, other address", (c("n_tset") >= 90) & (c("a_tset") < 70)),
        ("renamed at the address", (c("n_tset") < 50) & (c("a_tset") >= 85)),
        ("transliteration", c("p_n_indic") == 1),
        ("domain name", c("p_n_is_domain") == 1),
        ("typo", (c("n_skel_ratio") >= 90) & (c("n_ratio") < 90)),
        ("address variation", c("a_tset") < 85),
    ])


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries that got better, worse, or stayed, with their mean change."""
    d = before.select("q", F.col("f").alias("f0")).join(after.select("q", F.col("f").alias("f1")), "q").withColumn("d", F.col("f1") - F.col("f0"))
    return d.groupBy(cascade([("better", F.col("d") > 1e-12), ("worse", F.col("d") < -1e-12)], "same").alias("change")).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"))


def calibration_error(pairs: DataFrame, by: list[str] | None = None, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins of probability, for all or by group."""
    binned = pairs.withColumn("bin", F.floor(F.least(F.col("prob") * bins, F.lit(bins - 1.0))))
    cells = binned.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.abs(F.avg("prob") - F.avg("y")).alias("gap"))
    return cells.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def empty_calibration(pairs: DataFrame, cuts: tuple[float, ...] = (0.05, 0.2, 0.5, 0.8, 0.95)) -> DataFrame:
    """Predicted (product of 1 - p) and actual share of queries without a match, in right-closed bins of the prediction."""
    q = pairs.groupBy("q").agg(F.exp(F.sum(F.log1p(-F.least("prob", F.lit(1 - 1e-9))))).alias("p_empty"), F.max("y").alias("any"))
    band = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        band = F.when(F.col("p_empty") <= cut, i).otherwise(band)
    return q.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("p_empty").alias("predicted"), F.avg((F.col("any") == 0).cast("double")).alias("actual"))


def coherence(pairs: DataFrame) -> DataFrame:
    """How much probability pool records get in all, how often more than one, and the mean of second-best claims."""
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("prob"), "q")))
    sums = ranked.groupBy("p").agg(F.sum("prob").alias("s"), F.max(F.when(F.col("r") == 2, F.col("prob"))).alias("second"))
    return sums.agg(F.count("*").alias("n"), F.avg("s").alias("mean_sum"), F.avg((F.col("s") > 1).cast("double")).alias("over_one"), F.avg("second").alias("mean_second"))


def spearman(df: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """Rank correlation within each group, average ranks for ties."""

    def average_rank(c: str) -> Column:
        w = Window.partitionBy(by).orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    return df.withColumn("ra", average_rank(a)).withColumn("rb", average_rank(b)).groupBy(by).agg(F.corr("ra", "rb").alias("rho"))


def auc(scored: DataFrame, value: str = "prob", label: str = "y", cells: int = 10_000) -> DataFrame:
    """Area under the ROC curve, exactly.

    Negatives below each score are counted in two steps, so that no task sees all scores: those of lower cells of
    probability, of which there are ``cells`` at most, and those of lower scores in the same cell.
    """
    cell = F.least(F.greatest(F.floor(F.col(value) * cells), F.lit(0)), F.lit(cells))
    byscore = scored.groupBy(cell.alias("cell"), F.col(value).alias("v")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    lower = byscore.groupBy("cell").agg(F.sum("neg").alias("neg")).select("cell", F.coalesce(F.sum("neg").over(upto), F.lit(0)).alias("lower"))
    inside = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = byscore.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(lower), "cell")  # one row a cell
    wins = F.col("pos") * (F.col("lower") + F.col("below") + F.col("neg") / 2)
    return ranked.agg((F.sum(wins) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def profile(df: DataFrame, column: str) -> DataFrame:
    """Counts, distinct values, empties, mean and quantiles of the length of a text column."""
    size = F.length(F.coalesce(column, F.lit("")))
    return df.agg(
        F.count("*").alias("n"), F.countDistinct(column).alias("n_distinct"), F.count_if(size == 0).alias("n_empty"), F.avg(size).alias("mean_length"),
        *[F.percentile(size, q).alias(f"length_p{int(q * 100)}") for q in (0.5, 0.9, 0.99)],
    )


def truth_structure(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(size, n): how many queries have how many matches."""
    sizes = queries.join(truth.groupBy("q").agg(F.count("*").alias("size")), "q", "left").na.fill(0, ["size"])
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def owners_twice(truth: DataFrame) -> DataFrame:
    return truth.groupBy("p").agg(F.countDistinct("q").alias("n")).where("n > 1")


def margins(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Cross-tab with totals in long form; null stands for all."""
    return df.cube(rows, columns).agg(F.count("*").alias("n"))
