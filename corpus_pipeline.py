"""Corpus pipeline: quality, toxicity, near-duplicates, packing; each stage works on what its predecessor kept.

Quality and toxicity are fitted on the labelled documents of a stage's own input and reject what they predict to be
poor or toxic. Of each group of near-duplicates the smallest doc_id stays. The last stage packs what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkwright.llm import quality, toxicity
from linkwright.llm.common import materialise, ready, table
from linkwright.llm.packing import pack_documents
from linkwright.llm.simhash import keep_one


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier = quality.fit(docs, table(ready(spark), sf_dir, "labels"))
    return toxicity.keep(docs, classifier, quality.THRESHOLD, 1)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classifier = toxicity.fit(docs, table(ready(spark), sf_dir, "labels"))
    return toxicity.keep(docs, classifier, toxicity.THRESHOLD, 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: SQL can express neither the trained stages nor best-fit packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
