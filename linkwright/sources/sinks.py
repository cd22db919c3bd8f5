"""Sinks: sets as TSV, stage tables, experiment log, and the contract of the outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def set_rows(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """``pairs(q_id, p_id)``, ``queries(q_id, position)`` -> one row a query in order, ids sorted and comma-joined, "" for none."""
    sets = pairs.join(queries.select("q_id"), "q_id", "left_semi").groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set("p_id")), ",").alias("ids"))
    return queries.join(sets, "q_id", "left").select("position", "q_id", F.coalesce("ids", F.lit("")).alias("ids"))


def write_sets(rows: DataFrame, path: str, column: str, one_file: bool = False) -> None:
    """TSV with a header, in the order of ``position``; part files follow one another unless ``one_file`` asks for a single task."""
    out = rows.orderBy("position").select(F.col("q_id").alias("source1_entity_id"), F.col("ids").alias(column))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", nullValue="").csv(path)


def contract(matches: DataFrame, candidates: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(rule, violations) of two set tables ``(q_id, ids)``: coverage, uniqueness, ids of the pool, matches among candidates."""
    spark = matches.sparkSession
    exploded = {n: t.select("q_id", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("p_id")) for n, t in (("match", matches), ("candidate", candidates))}
    checks = []
    for name, t in (("match", matches), ("candidate", candidates)):
        e = exploded[name]
        checks += [
            (f"{name}: query without a row", queries.join(t, "q_id", "left_anti")),
            (f"{name}: row without a query", t.join(queries, "q_id", "left_anti")),
            (f"{name}: query twice", t.groupBy("q_id").count().where("count > 1")),
            (f"{name}: id twice", e.groupBy("q_id", "p_id").count().where("count > 1")),
            (f"{name}: id not in the pool", e.join(pool, "p_id", "left_anti")),
        ]
    checks.append(("match: not among the candidates", exploded["match"].join(exploded["candidate"], ["q_id", "p_id"], "left_anti")))
    out = None
    for rule, bad in checks:
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else spark.createDataFrame([], "rule string, violations long")


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def append_record(spark: SparkSession, record: dict, path: str) -> None:
    """Adds a record, of whatever keys, to a log of JSON lines."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").write.mode("append").text(path)


def write_scores(scored: DataFrame, path: str, name: str = "prob") -> None:
    """Scores as a table keyed by pair."""
    write_stage(scored.select("q", "p", F.col(name).cast("double").alias("score")), path)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    """(q_id, ids) of a written set table."""
    return spark.read.schema("q_id string, ids string").options(sep="\t", header=True, quote="", escape="", enforceSchema=True).csv(path).na.fill("")


def validate(spark: SparkSession, match_path: str, candidate_path: str, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """The contract over written files; raises ``ValueError`` with the rules that don't hold."""
    found = contract(read_sets(spark, match_path), read_sets(spark, candidate_path), queries.select(F.col("q_id").cast("string").alias("q_id")), pool)
    broken = {r.rule: r.violations for r in found.where("violations > 0").collect()}  # a row a rule
    if broken:
        raise ValueError(f"the outputs break the contract: {broken}")
    return found
