"""A dictionary of transliterated tokens, learned from matching names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkwright.functions import arrays as A
from linkwright.functions import script
from linkwright.functions.kernels import similarity


def learn_tokens(pairs: DataFrame, min_count: int = 3, min_share: float = 0.5, min_similarity: float = 0.55) -> DataFrame:
    """``pairs(latin, other)`` of names that mean the same -> (token, target).

    Each token of an Indic name is aligned with the most similar token of the Latin one, the first of equals. A token's
    most frequent target is kept if it is frequent enough, by count and by share, and different.
    """
    usable = pairs.where(script.has_indic(F.col("other")) & ~script.has_indic(F.col("latin")))
    rows = usable.select(F.monotonically_increasing_id().alias("row"), A.words(script.fold(F.col("latin"))).alias("a"), A.words(script.fold(F.col("other"))).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    tokens = rows.select("row", "a", F.posexplode("b").alias("at", "token"))
    total = tokens.groupBy("token").agg(F.count("*").alias("total"))
    met = tokens.select("row", "at", "token", F.posexplode("a").alias("pos", "target")).withColumn("sim", similarity("jaro_winkler", F.col("token"), F.col("target")))
    best = Window.partitionBy("row", "at").orderBy(F.desc("sim"), "pos")
    aligned = met.withColumn("r", F.row_number().over(best)).where((F.col("r") == 1) & (F.col("sim") >= min_similarity) & (F.col("sim") > 0))
    counts = aligned.groupBy("token", "target").agg(F.count("*").alias("n"))
    modal = counts.groupBy("token").agg(F.max_by(F.struct("target", "n"), F.struct("n", "target")).alias("m")).select("token", "m.target", "m.n")
    return modal.join(total, "token").where((F.col("n") >= min_count) & (F.col("n") / F.col("total") >= min_share) & (F.col("token") != F.col("target"))).select("token", "target")


def dictionary(learned: DataFrame, most: int = 50_000) -> dict[str, str]:
    """``learned(token, target)`` as the dictionary that normalisation takes along to the workers; more than ``most`` entries are an error."""
    rows = learned.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} learned tokens: raise min_count or min_share")
    return {r.token: r.target for r in rows}
