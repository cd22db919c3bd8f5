"""Diagnostics of a linkage run: funnels, profiles, bands, agreement rates, loss of probabilities, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.hashing import md5_mod
from linkwright.operators.evaluate import cascade, per_query
from linkwright.operators.sampling import first_by_hash


def share(condition: Column) -> Column:
    """How often a condition holds where it is known."""
    return F.avg(condition.cast("double"))


def near_copy_counts(pairs: DataFrame, alike: Column, queries: DataFrame) -> DataFrame:
    """(copies, n_queries): how many queries have how many candidates that are near copies."""
    counts = queries.join(pairs.where(alike).groupBy("q").agg(F.count("*").alias("copies")), "q", "left").na.fill(0, ["copies"])
    return counts.groupBy("copies").agg(F.count("*").alias("n_queries"))


def near_copy_profile(copies: DataFrame) -> DataFrame:
    """How near copies differ, by whether anyone owns the record: ``copies`` has owned, same_name, extra_token, lacks_token, numbers_differ."""
    return copies.groupBy("owned").agg(F.count("*").alias("n"), *[share(F.col(c)).alias(c) for c in ("same_name", "extra_token", "lacks_token", "numbers_differ")])


def confidence_profile(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """By group of queries: mean best probability, share of sure and of hopeless queries, mean number of likely candidates."""
    q = pairs.groupBy("q").agg(F.max("prob").alias("top"), F.count_if(F.col("prob") >= 0.5).alias("likely")).join(groups, "q")
    return q.groupBy("grp").agg(F.count("*").alias("n"), F.avg("top").alias("mean_top"), share(F.col("top") >= 0.9).alias("sure"), share(F.col("top") < 0.5).alias("hopeless"), F.avg("likely").alias("mean_likely"))


def residual_bands(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lost score by the kind of loss and by the band of the best probability; ``scores`` are rows of ``per_query``."""
    kind = cascade([("none", F.col("f") >= 1), ("false match for an empty set", F.col("n_true") == 0), ("empty for a match", F.col("n_pred") == 0), ("all wrong", F.col("tp") == 0), ("too many", F.col("tp") == F.col("n_true"))], "too few")
    top = pairs.groupBy("q").agg(F.max("prob").alias("top"))
    band = cascade([("below .5", F.col("top") < 0.5), (".5 to .9", F.col("top") < 0.9)], "above .9")
    rows = scores.join(top, "q", "left").na.fill(0.0, ["top"])
    return rows.groupBy(kind.alias("kind"), band.alias("band")).agg(F.count("*").alias("n"), F.sum(1 - F.col("f")).alias("lost"))


def number_deltas(pairs: DataFrame) -> DataFrame:
    """By label, of pairs with ``delta`` between house numbers: how often they agree, and quantiles of the gap where not."""
    gap = F.when(F.col("delta") > 0, F.col("delta"))
    return pairs.groupBy("y").agg(F.count("*").alias("n"), share(F.col("delta") == 0).alias("agree"), *[F.percentile(gap, q).alias(f"gap_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)])


def retrieval_funnel(truth: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, kept): how many true pairs are still there after each stage."""
    own = truth.select("q", "p").distinct()
    rows = [(F.lit("truth"), own)] + [(F.lit(n), own.join(s.select("q", "p").distinct(), ["q", "p"], "left_semi")) for n, s in stages.items()]
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("kept")).select(n.alias("stage"), "kept") for n, t in rows])


def seen_unseen(pairs: DataFrame, trained: DataFrame) -> DataFrame:
    """Errors of pairs whose record was trained on and of others; ``trained(p)``."""
    flagged = pairs.join(trained.select("p").distinct().withColumn("seen", F.lit(1)), "p", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return flagged.groupBy("seen").agg(F.count("*").alias("n"), share((F.col("prob") >= 0.5) != (F.col("y") == 1)).alias("error"), F.avg("prob").alias("mean_prob"))


def set_sizes(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """By group: queries, mean set size, share of empty sets; ``sets(q, ps)``."""
    rows = sets.join(groups, "q").withColumn("n", F.size("ps"))
    return rows.groupBy("grp").agg(F.count("*").alias("n_queries"), F.avg("n").alias("mean_size"), share(F.col("n") == 0).alias("empty"))


def field_agreement(pairs: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """How often fields agree in true pairs, which have ``<field>_q`` and ``<field>_p``."""
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *[share(F.col(f"{f}_q") == F.col(f"{f}_p")).alias(f) for f in fields])


def links_by_source(pairs: DataFrame, source: str) -> DataFrame:
    return pairs.groupBy(source).agg(F.count("*").alias("n_links"), F.countDistinct("q").alias("n_queries"))


def seed_spread(runs: DataFrame) -> DataFrame:
    """Mean and sample standard deviation over runs of each run's mean score; ``runs(run, f)``."""
    return runs.groupBy("run").agg(F.avg("f").alias("f")).agg(F.count("*").alias("runs"), F.avg("f").alias("mean_f"), F.stddev_samp("f").alias("std_f"))


def log_loss(pairs: DataFrame, by: list[str] | None = None, clip: float = 1e-7) -> DataFrame:
    """Mean negative log-likelihood, and errors at 0.9."""
    p = F.least(F.greatest("prob", F.lit(clip)), F.lit(1 - clip))
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return pairs.groupBy(*(by or [])).agg(F.avg(loss).alias("log_loss"), F.count_if((F.col("prob") >= 0.9) != (F.col("y") == 1)).alias("errors"))


def reuse(wanted: DataFrame, known: DataFrame, compute) -> DataFrame:
    """Features of ``wanted(q, p)``: those already in ``known``, and ``compute`` of the others only."""
    missing = wanted.join(known.select("q", "p"), ["q", "p"], "left_anti")
    return known.join(wanted, ["q", "p"], "left_semi").unionByName(compute(missing).select(*known.columns))


def training_pairs(pairs: DataFrame, most: int = 3_000_000, seed: int = 0) -> DataFrame:
    """True pairs outside the holdout fold, at most ``most`` of them by hash."""
    return first_by_hash(pairs.where("fold <> 0"), ["q", "p"], most, seed)


def veto_grid(selected: DataFrame, truth: DataFrame, queries: DataFrame, taus: list[float], value: str = "copy_score", salt: str = "veto") -> DataFrame:
    """(tau, half, macro_f05) without selected pairs whose copy score reaches tau; one half of the queries selects, the other confirms."""
    halves = queries.withColumn("half", F.when(md5_mod(F.concat(F.col("q").cast("string"), F.lit("|" + salt)), 2) == 0, "select").otherwise("confirm"))
    rows = []
    for tau in taus:
        scores = per_query(selected.where(F.col(value) < tau), truth, halves)
        rows.append(scores.groupBy("half").agg(F.avg("f").alias("macro_f05")).select(F.lit(float(tau)).alias("tau"), "half", "macro_f05"))
    return reduce(DataFrame.unionByName, rows)


def cross_tab(df: DataFrame, rows: str, columns: str, values: list) -> DataFrame:
    """Shares of ``columns`` within each row, one column a value."""
    own = df.groupBy(rows).pivot(columns, values).count().na.fill(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{v}`") for v in values])
    return own.select(rows, *[(F.col(f"`{v}`") / total).alias(str(v)) for v in values])


def binned(df: DataFrame, column: str, edges: list[float], name: str = "bin") -> DataFrame:
    """Adds the number of the right-closed bin between edges; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((F.col(column) > edges[i - 1]) & (F.col(column) <= edges[i]), i - 1).otherwise(out)
    return df.withColumn(name, out)
