"""Compaction: merging layers, filters, version garbage collection and the level policy. Log in, log out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import be_u64
from ..schema import LATEST
from .resolve import latest, with_ord

#: Files in level 0 that start a compaction, bytes of level 1, growth from level to level, levels.
L0_FILES, L1_BYTES, GROWTH, LEVELS = 4, 1 << 20, 10, 7


def merge_entries(newer: DataFrame, older: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """(key, seq, value) of both, ``newer`` winning by position whatever the seqs; value null is a tombstone."""
    both = newer.select("key", "seq", "value", F.lit(0).alias("_src")).unionByName(older.select("key", "seq", "value", F.lit(1).alias("_src")))
    w = Window.partitionBy("key").orderBy("_src", F.col("seq").desc())
    out = both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return (out.where("value is not null") if drop_tombstones else out).select("key", "seq", "value")


@dataclass(frozen=True)
class Filter:
    """What happens to a live entry: removed where ``remove``, its value replaced where ``replace``; otherwise kept."""

    remove: Column | None = None
    replace: Column | None = None
    value: Column | None = None


def apply_filter(log: DataFrame, rule: Filter) -> DataFrame:
    """Tombstones (value null) pass. Removal leaves no tombstone; replacement keeps the seq."""
    live = F.col("value").isNotNull()
    if rule.remove is not None:
        log = log.where(~(live & F.coalesce(rule.remove, F.lit(False))))
    if rule.replace is not None:
        log = log.withColumn("value", F.when(live & F.coalesce(rule.replace, F.lit(False)), rule.value).otherwise(F.col("value")))
    return log


def expiry_prefix(now: int) -> Filter:
    """Values start with a big-endian unsigned 64-bit time in ms: remove those past it; 0 and shorter values stay."""
    at = be_u64(F.col("value").cast("binary"))
    return Filter(remove=(F.octet_length(F.col("value")) >= 8) & (at != 0) & (F.lit(now).cast("decimal(20,0)") > at))


def prefix_drop(prefix: str | bytes) -> Filter:
    return Filter(remove=F.startswith(F.col("key"), F.lit(prefix)))


def function_filter(decide: Callable[[Column, Column], Filter]) -> Filter:
    """decide(key, value) builds the rule from columns."""
    return decide(F.col("key"), F.col("value"))


def retain_versions(log: DataFrame, horizon: int, deepest: bool = False) -> DataFrame:
    """Per key the newest version and all with seq > horizon; at the deepest level a newest tombstone at or under it goes with its key.

    Versions after the horizon stay as they are. Of the others only a key's newest of all can stay, which a partial row limit finds:
    a key with any number of versions sends one row a task, and nothing is joined.
    """
    rows = with_ord(log)
    old = latest(rows).where(F.col("seq") <= horizon)
    if deepest:
        old = old.where("op <> 'del'")
    return rows.where(F.col("seq") > horizon).unionByName(old)


def retain_for_snapshots(log: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    """Per key the newest version of all and the newest at or under each snapshot: whatever some reader can still see.

    The snapshots cut the log in stretches, and what they see of a key is the newest of each stretch, found as in ``latest``.
    """
    rows = with_ord(log)
    stretch = F.lit(0)
    for s in sorted(set(snapshots)):
        stretch = stretch + (F.col("seq") > s).cast("int")
    w = Window.partitionBy("cf", "key", "_stretch").orderBy(F.col("seq").desc(), F.col("ord").desc())
    return rows.withColumn("_stretch", stretch).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_stretch")


def safe_horizon(active: Sequence[int]) -> int:
    return max(min(active) - 1, 0) if active else LATEST


def horizon_of(snapshots: DataFrame) -> DataFrame:
    """(horizon) of a table of snapshots (seq): what ``safe_horizon`` gives, as an aggregate."""
    return snapshots.agg(F.coalesce(F.greatest(F.min("seq") - 1, F.lit(0)), F.lit(LATEST)).alias("horizon"))


@dataclass(frozen=True)
class Job:
    level: int
    inputs: tuple[str, ...]
    target: int
    drop_tombstones: bool


def l0_needs_compaction(n_files: int) -> bool:
    return n_files >= L0_FILES


def find_job(levels: Sequence[Sequence[tuple[str, int]]]) -> Job | None:
    """levels: (file, bytes) of each. Level 0 first, else the first level over its bytes, its oldest file with all of the next."""
    levels = [list(x) for x in levels] + [[] for _ in range(LEVELS - len(levels))]
    if l0_needs_compaction(len(levels[0])):
        return Job(0, tuple(f for f, _ in levels[0] + levels[1]), 1, not any(levels[2:]))
    for k in range(1, LEVELS - 1):
        if sum(b for _, b in levels[k]) > L1_BYTES * GROWTH ** (k - 1):
            return Job(k, (levels[k][0][0], *(f for f, _ in levels[k + 1])), k + 1, k + 1 == LEVELS - 1)
    return None


def compact(log: DataFrame, snapshots: Sequence[int] = (), drop_tombstones: bool = False, now: int | None = None) -> DataFrame:
    """The log without versions that no reader can see. Tombstones and expired versions go only if nothing older lies deeper."""
    out = retain_for_snapshots(log, snapshots)
    if drop_tombstones and not snapshots:
        dead = F.col("op") == "del"
        if now is not None:
            dead = dead | ((F.col("expires_at") != 0) & (F.col("expires_at") <= now))
        out = out.where(~dead)
    return out
