"""Stand-ins: driver tables in the roles of records, scored pairs and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str, query: str = "l_orderkey") -> DataFrame:
    """(q, p, prob, y, num_agree): line items as candidate pairs."""
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(F.col(query).alias("q"), F.col("l_partkey").alias("p")).agg(
        F.max(F.col("l_extendedprice") / 110000).alias("prob"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("num_agree"),
    )


def scored_sql(query: str = "l_orderkey") -> str:
    return f"""pairs AS (SELECT {query} AS q, l_partkey AS p, max(l_extendedprice / 110000) AS prob,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS num_agree
      FROM lineitem GROUP BY 1, 2)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, p, s_price, s_quantity, s_combo, y): three scores for each pair of supplier and part."""
    items = read(spark, sf_dir, "lineitem")
    return items.groupBy(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("p")).agg(
        F.max(F.col("l_extendedprice") / 110000).alias("s_price"),
        F.max(F.col("l_quantity") / 50 - F.col("l_tax")).alias("s_quantity"),
        F.max(F.col("l_discount") + F.col("l_extendedprice") / 220017).alias("s_combo"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"),
    )


CHANNELS_SQL = """ch AS (SELECT l_suppkey AS q, l_partkey AS p, max(l_extendedprice / 110000) AS s_price,
        max(l_quantity / 50 - l_tax) AS s_quantity, max(l_discount + l_extendedprice / 220017) AS s_combo,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y FROM lineitem GROUP BY 1, 2)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' sums agree."""
    return df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema])
