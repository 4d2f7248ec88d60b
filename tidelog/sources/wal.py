"""Write-ahead log integrity, group commit and manifest replay as operators over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import record_crc

FIELDS = ("cf", "key", "seq", "ord", "op", "value", "expires_at")


def with_crc(log: DataFrame) -> DataFrame:
    return log.withColumn("crc", record_crc(*FIELDS))


def valid_prefix(log: DataFrame) -> DataFrame:
    """Rows of each column family before its first record whose checksum is wrong or whose op is unknown.

    The first bad position is one number a family, from a partial aggregate; no sort, no single task.
    """
    bad = (F.col("crc") != record_crc(*FIELDS)) | F.col("crc").isNull() | ~F.coalesce(F.col("op").isin("put", "ttl", "del"), F.lit(False))
    first = log.where(bad).groupBy("cf").agg(F.min("seq").alias("_bad"))
    return log.join(first, "cf", "left").where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")


def group_commit(log: DataFrame, size: int) -> DataFrame:
    """(generation, n_records, first_seq, last_seq): commits of ``size`` consecutive records."""
    generation = F.expr(f"(seq - 1) div {size}")
    return log.groupBy(generation.alias("generation")).agg(F.count(F.lit(1)).alias("n_records"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def replay_manifest(actions: DataFrame) -> DataFrame:
    """(cf, level, filename) of the files whose last action is 'add'; batch_id orders actions, an add after a remove of one batch wins."""
    order = F.struct("batch_id", F.when(F.col("action") == "add", 1).otherwise(0))
    files = actions.where(F.col("action").isin("add", "remove")).groupBy("cf", "filename").agg(F.max_by(F.struct("action", "level"), order).alias("a"))
    return files.where("a.action = 'add'").select("cf", F.col("a.level").alias("level"), "filename")


def manifest_cfs(actions: DataFrame) -> DataFrame:
    return actions.select("cf").distinct()


def compaction_input(actions: DataFrame) -> DataFrame:
    """Files and levels per family, for the level policy."""
    w = Window.partitionBy("cf", "level")
    return replay_manifest(actions).withColumn("n_files", F.count(F.lit(1)).over(w))
