"""From scored pairs to match sets: precision first, each pool record claimed at most once but for exact ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.05


def exclusive(pairs: DataFrame, value: str = "prob") -> DataFrame:
    """Of each pool record's pairs, those with its highest value."""
    return pairs.withColumn("_best", F.max(value).over(Window.partitionBy("p"))).where(F.col(value) >= F.col("_best")).drop("_best")


def threshold_policy(pairs: DataFrame, threshold: float, value: str = "prob", claim_once: bool = True) -> DataFrame:
    sure = pairs.where(F.col(value) >= threshold)
    return exclusive(sure, value) if claim_once else sure


def expected_f(pairs: DataFrame, value: str = "prob") -> DataFrame:
    """Adds for each query: k, the prefix's expected F0.5 (ef) and the probability that no candidate matches (p_empty)."""
    whole = Window.partitionBy("q")
    prefix = whole.orderBy(F.desc(value), "p").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("double")
    return pairs.withColumns({
        "k": F.row_number().over(whole.orderBy(F.desc(value), "p")),
        "_hits": F.sum(v).over(prefix),
        "_all": F.sum(v).over(whole),
        "p_empty": F.exp(F.sum(F.log1p(-F.least(v, F.lit(1 - 1e-9)))).over(whole)),
    })


def expected_f_policy(pairs: DataFrame, miss: float = 0.0, value: str = "prob", claim_once: bool = True, floor: float = 0.0) -> DataFrame:
    """The prefix of each query's candidates with the best expected F0.5; none if an empty set is likelier right.

    ``miss`` is the mass of matches that were never retrieved.
    """
    likely = pairs.where(F.col(value) >= FLOOR)
    scored = expected_f(exclusive(likely, value) if claim_once else likely, value)
    scored = scored.withColumn("ef", 1.25 * F.col("_hits") / (F.col("k") + 0.25 * (F.col("_all") + miss)))
    whole = Window.partitionBy("q")
    scored = scored.withColumn("_best", F.max("ef").over(whole))
    scored = scored.withColumn("_stop", F.min(F.when(F.col("ef") >= F.col("_best") - 1e-12, F.col("k"))).over(whole))
    kept = (F.col("k") <= F.col("_stop")) & (F.col("_best") > F.col("p_empty")) & (F.col(value) >= floor)
    return scored.where(kept).drop("k", "_hits", "_all", "p_empty", "ef", "_best", "_stop")


def gated_expected_f_policy(pairs: DataFrame, gate: float = 0.6, miss: float = 0.0, value: str = "prob") -> DataFrame:
    """``expected_f_policy`` for queries whose best candidate of all reaches ``gate``."""
    marked = pairs.withColumn("_top", F.max(value).over(Window.partitionBy("q")))
    return expected_f_policy(marked, miss, value).where(F.col("_top") >= gate).drop("_top")


def conditional_policy(pairs: DataFrame, threshold: float = 0.9, agree: str = "num_agree", value: str = "prob") -> DataFrame:
    """Pairs over the threshold, and gated expected-F picks where house numbers agree; each record claimed once."""
    picked = gated_expected_f_policy(pairs, 0.6, 0.3, value).where(F.col(agree) == 1)
    both = pairs.where(F.col(value) >= threshold).unionByName(picked).dropDuplicates(["q", "p"])
    return exclusive(both, value)


def policies() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Policies by name."""
    at = lambda t: lambda x: threshold_policy(x, t)
    own = {f"thr{t:g}": at(t) for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)}
    own["thr0.5_shared"] = lambda x: threshold_policy(x, 0.5, claim_once=False)
    own["expF"] = lambda x: expected_f_policy(x)
    own["expF_miss0.3"] = lambda x: expected_f_policy(x, 0.3)
    own["expF_gate0.6"] = lambda x: gated_expected_f_policy(x, 0.6, 0.3)
    return own


def to_sets(selected: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, ps): sorted matches of every query of ``queries(q)``, an empty array for none; pairs of other queries are ignored."""
    sets = selected.groupBy("q").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    return queries.join(sets, "q", "left").select("q", F.coalesce("ps", F.array().cast(sets.schema["ps"].dataType)).alias("ps"))


def sweep(pairs: DataFrame, chosen: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(policy, q, p) of several policies over one table of scored pairs."""
    out = None
    for name, policy in chosen.items():
        one = policy(pairs).select(F.lit(name).alias("policy"), "q", "p")
        out = one if out is None else out.unionByName(one)
    return out


def veto(selected: DataFrame, name_sim: str, addr_sim: str, numbers_differ: str, at: float) -> DataFrame:
    """Without near-exact copies (both similarities at least ``at``) whose house numbers differ."""
    return selected.where(~((F.col(name_sim) >= at) & (F.col(addr_sim) >= at) & (F.col(numbers_differ) == 1)))
