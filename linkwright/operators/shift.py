"""Corrections for a distribution that shifted between training and use, without labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-7
#: Rates of a differing house number and of an extra name token among distractors and among true matches.
NUMBER_RATES, TOKEN_RATES = (0.899, 0.153), (0.472, 0.134)
STRONG_NAME, STRONG_ADDRESS = 90, 85


def _clipped(p: Column) -> Column:
    return F.greatest(F.least(p.cast("double"), F.lit(1 - CLIP)), F.lit(CLIP))


def reweight(p: Column, old: Column, new: Column) -> Column:
    """A probability under prior ``old``, under prior ``new``."""
    a, b = new / old * _clipped(p), (1 - new) / (1 - old) * (1 - _clipped(p))
    return a / (a + b)


def em_prior(scored: DataFrame, group: str, prior: float, rounds: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """(group, prior): each group's prior by expectation maximisation.

    One aggregation sums probabilities up in cells of one ten-thousandth, with their mean. Inside a cell the step is all but
    straight, so the mean stands for its rows (tests compare with all rows). Each group then iterates over its ten
    thousand numbers at most in a task of its own.
    """
    cells = scored.groupBy(group, F.round(_clipped(F.col("prob")), 4).alias("cell")).agg(F.count("*").cast("double").alias("n"), F.avg(_clipped(F.col("prob"))).alias("p"))
    out = f"`{group}` {scored.schema[group].dataType.simpleString()}, prior double"

    def one(own: pd.DataFrame) -> pd.DataFrame:
        n, p, pi = own["n"].to_numpy(), own["p"].to_numpy(), prior
        for _ in range(rounds):
            a, b = pi / prior * p, (1 - pi) / (1 - prior) * (1 - p)
            before, pi = pi, float((n * a / (a + b)).sum() / n.sum())
            if abs(pi - before) < tolerance:
                break
        return pd.DataFrame({group: own[group].iloc[:1], "prior": [pi]})

    return cells.groupBy(group).applyInPandas(one, out)


def correct_by_group(scored: DataFrame, group: str, prior: float, priors: DataFrame) -> DataFrame:
    return scored.join(priors.withColumnRenamed("prior", "_pi"), group).withColumn("prob", reweight(F.col("prob"), F.lit(prior), F.col("_pi"))).drop("_pi")


def near_copies(pairs: DataFrame) -> DataFrame:
    """Pairs alike in name and address, the best of each record by name."""
    w = Window.partitionBy("p").orderBy(F.desc("n_tset"), "q")
    return pairs.where((F.col("n_tset") >= STRONG_NAME) & (F.col("a_tset") >= STRONG_ADDRESS)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def distractor_share(copies: DataFrame, group: str) -> DataFrame:
    """(group, share): of distractors among near copies, from how often numbers differ and names gain a token; ALL for all.

    ``copies`` has differs (null where a number is missing) and extra, both 0/1.
    """
    agg = [F.avg("differs").alias("d"), F.avg("extra").alias("e")]
    rows = copies.groupBy(F.col(group).cast("string").alias(group)).agg(*agg).unionByName(copies.agg(*agg).withColumn(group, F.lit("ALL")))
    scale = lambda c, r: (F.col(c) - r[1]) / (r[0] - r[1])
    mean = (scale("d", NUMBER_RATES) + scale("e", TOKEN_RATES)) / 2
    return rows.select(group, F.greatest(F.least(mean, F.lit(0.99)), F.lit(0.01)).alias("share"))


def correct_odds(p: Column, reference: Column, target: Column) -> Column:
    """A near copy's probability when the share of distractors is ``target`` instead of ``reference``."""
    odds = _clipped(p) / (1 - _clipped(p)) * ((1 - target) / (1 - reference)) / (target / reference)
    return odds / (1 + odds)


def agreeing_share(pairs: DataFrame, group: str) -> DataFrame:
    """(group, agree): how often house numbers agree among near copies where both are known."""
    return near_copies(pairs).groupBy(group).agg(F.avg(F.when(F.col("num_state") >= 0, F.col("num_state"))).alias("agree"))
