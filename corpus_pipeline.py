"""A training-data pipeline over documents: each stage works on what the one before has kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, mixing, neardup, quality, sharding
from tessera.llm.common import checkpoint_dir, release, table


#: Shared shingles in 100 from which two documents are near-duplicates here.
NEAR = 80


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs, link=NEAR)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, sharding.OP1_MAX_BYTES)


STAGES = [("quality_rules", _quality), ("near_dedup", _near_dedup), ("decontamination", _decontaminate), ("mixing", _mix), ("sharding", _shard)]
#: Signatures and the latent search aren't SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of what all stages keep. Between stages documents are Parquet in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    read = []
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        release(spark, *read)  # what the stage before wrote has been read
        read = [f"{base}/{name}"]
        docs = spark.read.parquet(*read)
    return STAGES[-1][1](spark, docs, sf_dir)
