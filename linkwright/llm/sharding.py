"""Sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a prime-sized table, its order of preference. The shards
take turns claiming the first slot they prefer that is still free, until the table is full, so their
shares differ by one slot at most and few slots move when a shard leaves. A key's slot
is its hash modulo the table size; the table is broadcast (``slots`` rows, a parameter), so placement is one lookup.

Nulls: a null key has a slot of its own like any other value. Empty table: no rows. Equal keys share
a shard. Extra columns are kept by ``place`` unless their names are ``slot`` or ``shard``, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.common import table

SLOTS = 65_537
SHARDS = 256


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}|{name}".encode(), digest_size=8).digest(), "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard's number for every slot."""
    if not is_prime(slots) or len(shards) > slots or not shards or len(set(shards)) < len(shards):
        raise ValueError("slots must be prime, and shards distinct and no more than the slots")
    order = sorted(range(len(shards)), key=lambda i: shards[i])  # the turn doesn't depend on the order given
    at = {i: _hash(shards[i], "offset") % slots for i in order}
    step = {i: _hash(shards[i], "step") % (slots - 1) + 1 if slots > 2 else 1 for i in order}
    taken, left = [-1] * slots, slots
    while left:
        for i in order:
            while taken[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            taken[at[i]] = i
            left -= 1
            if not left:
                break
    return taken


def place(df: DataFrame, key: Column, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row."""
    rows = [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))]
    lookup = F.broadcast(df.sparkSession.createDataFrame(rows, "slot int, shard string"))
    keyed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    return keyed.join(lookup, "slot", "left")


def write_shards(df: DataFrame, key: Column, shards: Sequence[str], path: str, slots: int = SLOTS) -> None:
    """Writes every row under its shard's folder."""
    place(df, key, shards, slots).write.partitionBy("shard").parquet(path)


def op2_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = place(docs.select("doc_id"), F.col("doc_id"), [f"shard-{i:04d}" for i in range(SHARDS)])
    return placed.select("doc_id", F.col("slot").cast("long").alias("slot"), "shard")
