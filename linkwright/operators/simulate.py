"""Simulated splits: dropped queries, a smaller universe, and injected near copies; all deterministic by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.functions.hashing import dropped

RATE, NUMBER, ADD, DROP, AFTER, REACH = 0.6, 0.90, 0.47, 0.11, 0.7, 12


def drop_queries(records: DataFrame, rate: float, salt: str = "drop") -> DataFrame:
    """Without a share of the queries; their matches stay, as distractors. ``records(entity_id, is_query)``."""
    return records.where(~(F.col("is_query") & dropped(F.col("entity_id"), rate, salt)))


def smaller_universe(records: DataFrame, truth: DataFrame, rate: float = 0.5, salt: str = "univ") -> DataFrame:
    """Without a share of the queries and without their true matches; ``truth(q_id, p_id)``."""
    gone = records.where(F.col("is_query") & dropped(F.col("entity_id"), rate, salt)).select(F.col("entity_id").alias("q_id"))
    theirs = truth.join(gone, "q_id").select(F.col("p_id").alias("entity_id"))
    return records.join(gone.withColumnRenamed("q_id", "entity_id").unionByName(theirs).distinct(), "entity_id", "left_anti")


def uniform(*keys: Column | str) -> Column:
    """A number between 0 and 1 from the first forty bits of md5 of the keys."""
    digest = F.md5(F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]))
    return (F.conv(F.substring(digest, 1, 10), 16, 10).cast("long") + 0.5) / (1 << 40)


def poisson(mean: float, u: Column, most: int = 12) -> Column:
    import math

    total, out = 0.0, F.lit(0)
    for k in range(most):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        out = out + (u > total).cast("int")
    return out


def perturbed_copies(records: DataFrame, tokens: list[str], rate: float = RATE, seed: int = 0) -> DataFrame:
    """(source_id, copy, name, address): near copies of ``records(entity_id, name, address)``, a Poisson number of each.

    A copy's first number moves by up to ``REACH``, its name may gain one of ``tokens`` (title case, at the end more often than in
    front), and one of three name tokens or more may go.
    """
    n = poisson(rate, uniform(F.col("entity_id"), "copies", F.lit(seed)))
    rows = records.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    u = lambda what: uniform(F.col("entity_id"), F.col("copy"), what, F.lit(seed))
    number = F.regexp_extract("address", "([0-9]+)", 1)
    old = number.cast("decimal(38,0)")
    step = F.floor(u("step") * REACH) + 1
    moved = F.when(old > 1, F.greatest(F.lit(1), old + F.when(u("sign") < 0.5, -step).otherwise(step))).otherwise(old + step)
    at = F.instr(F.col("address"), number)
    address = F.when((number != "") & (F.length(number) <= 18) & (u("number") < NUMBER), F.concat(F.substr("address", F.lit(1), at - 1), moved.cast("long").cast("string"), F.substr("address", at + F.length(number)))).otherwise(F.col("address"))
    words = F.filter(F.split("name", " "), lambda t: t != "")
    vocabulary = F.array(*[F.lit(t.title()) for t in tokens]) if tokens else None
    if vocabulary is not None:
        token = F.array(F.element_at(vocabulary, (F.floor(u("token") * len(tokens)) + 1).cast("int")))
        words = F.when(u("add") < ADD, F.when(u("place") < AFTER, F.concat(words, token)).otherwise(F.concat(token, words))).otherwise(words)
    gone = (F.floor(u("which") * F.size("_w")) + 1).cast("int")
    cut = F.when((F.size("_w") > 2) & (u("drop") < DROP), F.filter("_w", lambda t, i: i + 1 != gone)).otherwise(F.col("_w"))
    out = rows.withColumn("_w", words).withColumn("_name", F.array_join(cut, " ")).withColumn("_address", address)
    return out.select(F.col("entity_id").alias("source_id"), "copy", F.col("_name").alias("name"), F.col("_address").alias("address"))
