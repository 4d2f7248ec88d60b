"""Log views over the event table: one mutation an event, a range delete every 400th."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expiring puts live a week.
TTL_MS = 7 * 24 * 3600 * 1000


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 4, "0"), F.lit(":"), (F.col("event_id") % 7).cast("string"))
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    kind = F.col("event_type")
    return e.select(
        F.when(kind == "signup", "meta").otherwise("default").alias("cf"),
        key.alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.lit(0).alias("ord"),
        F.when(kind == "error", "del").when(kind == "purchase", "ttl").otherwise("put").alias("op"),
        F.when(kind != "error", F.concat(kind, F.lit("#"), F.col("event_id").cast("string"))).alias("value"),
        F.when(kind == "purchase", ms + TTL_MS).otherwise(F.lit(0).cast("long")).alias("expires_at"),
    )


def kv_range_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 400 = 399")
    bound = lambda c: F.concat(F.lit("user:"), F.lpad(c.cast("string"), 4, "0"))
    return e.select(F.lit("default").alias("cf"), bound(F.col("user_id")).alias("lo"), bound(F.col("user_id") + 3).alias("hi"), (F.col("event_id") + 1).alias("seq"))
