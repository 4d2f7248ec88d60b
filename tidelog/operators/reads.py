"""Point, multi-point, range, prefix and full reads.

Predicates on cf and key sit below resolution, where Catalyst pushes them to the scan: only the versions of wanted keys
are deduplicated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_CF, LATEST
from .resolve import latest, resolve

BROADCAST_KEYS = 200_000


def get(log: DataFrame, key, cf: str = DEFAULT_CF, range_dels: DataFrame | None = None, seq: int | None = None, now=None) -> DataFrame:
    """The live row of one key, or none."""
    return resolve(log.where((F.col("cf") == cf) & (F.col("key") == key)), range_dels, seq, now)


def lookup_state(log: DataFrame, key, cf: str = DEFAULT_CF) -> DataFrame:
    """One row: state 'absent', 'tombstone' or 'value', and the newest version's seq and value."""
    newest = log.where((F.col("cf") == cf) & (F.col("key") == key)).agg(F.max_by(F.struct("op", "value", "seq"), F.struct("seq", "ord")).alias("v"))
    state = F.when(F.col("v").isNull(), "absent").when(F.col("v.op") == "del", "tombstone").otherwise("value")
    return newest.select(state.alias("state"), F.col("v.seq").alias("seq"), F.col("v.value").alias("value"))


def multi_get(log: DataFrame, keys: DataFrame | Sequence, cf: str = DEFAULT_CF, range_dels: DataFrame | None = None, seq: int | None = None, now=None) -> DataFrame:
    """The live rows of many keys. Up to BROADCAST_KEYS keys are broadcast, more are joined by shuffle."""
    if not isinstance(keys, DataFrame):
        keys = log.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    keys = keys.select("key").distinct()
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return resolve(log.where(F.col("cf") == cf).join(F.broadcast(keys) if small else keys, "key", "left_semi"), range_dels, seq, now)


def scan(log: DataFrame, lo, hi, cf: str = DEFAULT_CF, range_dels: DataFrame | None = None, seq: int | None = None, now=None, ordered: bool = True) -> DataFrame:
    """Live rows with lo <= key < hi by key; none if lo >= hi or hi is empty."""
    rows = resolve(log.where((F.col("cf") == cf) & (F.col("key") >= lo) & (F.col("key") < hi)), range_dels, seq, now)
    return rows.orderBy("key") if ordered else rows


def successor(prefix: bytes) -> bytes | None:
    """The least bytes above all that start with prefix; None if there are none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def has_prefix(key: Column, prefix) -> Column:
    """startswith; for binary keys also the range that it implies, as only ranges of binary reach the scan."""
    out = F.startswith(key, F.lit(prefix))
    if isinstance(prefix, bytes) and prefix:
        out = (key >= F.lit(prefix)) & out
        if (end := successor(prefix)) is not None:
            out = out & (key < F.lit(end))
    return out


def scan_prefix(log: DataFrame, prefix, cf: str = DEFAULT_CF, range_dels: DataFrame | None = None, seq: int | None = None, now=None, ordered: bool = True) -> DataFrame:
    """Live rows whose key starts with prefix, by key; an empty prefix is all of the column family."""
    rows = resolve(log.where((F.col("cf") == cf) & has_prefix(F.col("key"), prefix)), range_dels, seq, now)
    return rows.orderBy("key") if ordered else rows


def iterate(log: DataFrame, cf: str | None = DEFAULT_CF, range_dels: DataFrame | None = None, seq: int | None = None, now=None) -> DataFrame:
    """All live rows in key order (a distributed sort). cf None: of all families, by family and key."""
    rows = resolve(log if cf is None else log.where(F.col("cf") == cf), range_dels, seq, now)
    return rows.orderBy("cf", "key")


def cf_stats(log: DataFrame) -> DataFrame:
    """Per column family: records, keys, tombstones, accounted bytes (16 a record beside key and value) and newest seq."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16
    return log.groupBy("cf").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("key").alias("n_keys"),
        F.sum(F.when(F.col("op") == "del", 1).otherwise(0)).cast("long").alias("n_tombstones"),
        F.sum(size).cast("long").alias("n_bytes"),
        F.max("seq").alias("max_seq"),
    )


def list_cfs(log: DataFrame) -> DataFrame:
    return log.select("cf").distinct().orderBy("cf")


def write_seq(log: DataFrame) -> int:
    """The next seq to hand out: 1 for an empty log."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def key_write_seq(log: DataFrame) -> DataFrame:
    """(cf, key, write_seq): the newest seq of each key, tombstones and expired versions included."""
    return log.groupBy("cf", "key").agg(F.max("seq").alias("write_seq"))


def key_count(log: DataFrame, cf: str = DEFAULT_CF, seq: int | None = None, now=None) -> int:
    return resolve(log.where(F.col("cf") == cf), None, seq, now).count()


__all__ = ["LATEST", "cf_stats", "get", "has_prefix", "iterate", "key_count", "key_write_seq", "latest", "list_cfs", "lookup_state", "multi_get", "scan", "scan_prefix", "successor", "write_seq"]
