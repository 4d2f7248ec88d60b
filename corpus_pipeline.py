"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and read again.
All but the last return the columns of ``documents``; the last returns where every remaining document lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, langid, mixing, neardup, sharding
from tidelog.llm.common import fresh, scratch_path, table

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language is found. A text that mixes languages stays, however small the share of each."""
    lang, score = fresh(docs.columns, "lang_pred", "lang_score")
    out = langid.identify(docs, langid.train(docs), (lang, score))
    return out.where(F.col(lang) != "und").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_representatives(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, out=tuple(fresh(docs.columns, "mix_topic", "mix_tokens", "probability"))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.placement(docs)


STAGES = [("language", language), ("near_dedup", dedup), ("decontamination", clean), ("mixing", mix), ("sharding", shard)]

#: Language ID and near-dedup can't be expressed in SQL; a test holds run() against an independent version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
