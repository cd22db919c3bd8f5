"""Incremental linkage over Structured Streaming: an extension of ours.

Scored pairs arrive in micro-batches; of each pool record the best claim so far is kept. Each batch writes a new version of
the claims beside the old one and then a marker with its number, so a batch that is replayed or half-written changes nothing; versions older than the one before go.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkwright.operators.decision import exclusive


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The claims after the last whole batch; None before the first."""
    try:
        last = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()[0]
        return spark.read.parquet(f"{path}/claims-{last}")
    except AnalysisException:
        return None


def merge(claims: DataFrame | None, batch: DataFrame, threshold: float) -> DataFrame:
    """The best claims of both, above the threshold."""
    new = batch.where(F.col("prob") >= threshold).select("q", "p", "prob")
    return exclusive((claims.unionByName(new) if claims is not None else new).distinct())


def keep_claims(pairs: DataFrame, path: str, checkpoint: str, threshold: float = 0.9, available_now: bool = True) -> StreamingQuery:
    """Starts a query that keeps ``path`` up to date with a stream of ``pairs(q, p, prob)``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merge(current(spark, path), batch, threshold).write.mode("overwrite").parquet(f"{path}/claims-{number}")
        spark.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{path}/done")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/claims-{number - 2}")  # the one before may still be read
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    writer = pairs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
