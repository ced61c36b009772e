"""A training corpus out of `documents`: toxic documents go, boilerplate lines go, one of each group of near
duplicates stays, documents with benchmark passages go, and what is left is packed into token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veiltab.llm import boilerplate, common, decontaminate, minhash, packing, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", boilerplate.stage),
    ("near_dedup", minhash.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]
#: Compression lengths and sketches have no SQL form: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
