"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is an aggregation and an equi-join over the links; nothing is gathered in one place. The links
are written to the shared folder after each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkwright.llm.common import drop_table, materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    met = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def ranked(first_id: str, key: str) -> Column:
    """A node that sorts by the smallest id of its rows, null ids last; so a root tells its component's smallest id."""
    return F.struct(F.col(first_id).isNull().alias("none"), F.col(first_id).alias("first_id"), F.col(key).alias("key"))


def ranked_components(links: DataFrame, nodes: DataFrame, key: str, first_id: str) -> DataFrame:
    """(key, root_key, component_id) of every linked node; ``links(a, b)`` hold keys of ``nodes(key, first_id)``.

    The smallest id of a component comes with its root, so nothing has to be gathered by component, however large one is.
    """
    side = lambda k: nodes.select(F.col(key).alias(k), ranked(first_id, key).alias(f"_{k}"))
    named = links.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    found = connected_components(named)
    return found.select(F.col("node.key").alias(key), F.col("root.key").alias("root_key"), F.col("root.first_id").alias("component_id"))


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of longs or ordered structs -> ``(node, root)``: every linked node with the smallest it reaches.

    Null ends, loops and repeated links are ignored; an empty table gives no rows.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "components")
    before = _state(now)
    for _ in range(rounds if before[0] else 0):
        after = materialise(_small_star(_large_star(now)), "components")
        drop_table(now)
        now, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        if before[0]:
            raise RuntimeError(f"no convergence in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
