"""Sources: TSV records and truth, cached stage tables, JSON logs and dictionaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import EngineConfig
from linkwright.schema import SOURCE, TRUTH


def _tsv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Header, tabs, no quoting; columns by position; empty fields are empty strings."""
    return spark.read.schema(schema).options(sep="\t", header=True, quote="", escape="", enforceSchema=True, mode="PERMISSIVE").csv(path).na.fill("")


def read_source(spark: SparkSession, config: EngineConfig, split: str, k: int) -> DataFrame:
    return _tsv(spark, config.source(split, k), SOURCE).withColumn("src", F.lit(k).cast("tinyint"))


def read_split(spark: SparkSession, config: EngineConfig, split: str) -> DataFrame:
    """All three sources with a stable key ``rid`` from the entity id."""
    parts = [read_source(spark, config, split, k) for k in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("rid", F.xxhash64("entity_id"))


def read_truth(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """(q_id, p_ids): every query with the list of its matches, empty if it has none."""
    raw = _tsv(spark, config.truth(), TRUTH)
    return raw.select(F.col("source1_entity_id").alias("q_id"), F.filter(F.split("matched_entity_ids", ","), lambda x: x != "").alias("p_ids"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("q_id", F.explode("p_ids").alias("p_id"))


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; it is built and written first if it isn't there."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def column_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def last_record(log: DataFrame, key: str, order: str) -> DataFrame:
    """Of a log with one record a line, the last one of each key."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def texts_of(spark: SparkSession, config: EngineConfig, split: str, ids: DataFrame) -> DataFrame:
    """Names and addresses of the records of ``ids(entity_id)`` alone."""
    return read_split(spark, config, split).join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", "business_name", "business_address")


def read_scores(spark: SparkSession, path: str, pairs: DataFrame, name: str = "prob") -> DataFrame:
    """``pairs(q, p, ...)`` with their saved scores; by key, never by position."""
    return pairs.join(spark.read.parquet(path).select("q", "p", F.col("score").alias(name)), ["q", "p"])


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines: dictionaries, specifications, logs."""
    return spark.read.schema(schema).json(path)
