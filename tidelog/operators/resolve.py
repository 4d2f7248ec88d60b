"""State resolution: which version of each key is visible.

The order is fixed: bound by sequence number, then keep the newest version of each key, then drop tombstones, expired
versions and what a later range delete covers. Dropping any of these before the newest is known would bring old versions back.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LATEST
from ..ship import ship

#: So few range deletes are broadcast, each row trying each; more are cut to disjoint pieces and met in key order.
FEW_RANGES = 64
#: Segments of the key space for that, and groups to which the rows of a segment are dealt.
SEGMENTS, SALTS = 256, 8


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def with_ord(log: DataFrame) -> DataFrame:
    return log if "ord" in log.columns else log.withColumn("ord", F.lit(0))


def as_of(log: DataFrame, seq: int | None) -> DataFrame:
    """The log as it was after write ``seq``. Reaches the scan as a pushed filter."""
    return log if seq is None or seq >= LATEST else log.where(F.col("seq") <= seq)


def latest(log: DataFrame) -> DataFrame:
    """The newest version of each (cf, key), tombstones included.

    row_number() = 1 lets Spark keep one row a key in each task before the shuffle (WindowGroupLimit), so a key with any
    number of versions costs one row a task.
    """
    rows = with_ord(log)
    w = Window.partitionBy("cf", "key").orderBy(F.col("seq").desc(), F.col("ord").desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def is_live(now: int | Column | None = None) -> Column:
    """Neither a tombstone nor expired at ``now`` (milliseconds): visible while now < expires_at."""
    at = now_ms() if now is None else now if isinstance(now, Column) else F.lit(now)
    return (F.col("op") != "del") & ((F.col("expires_at") == 0) | (at < F.col("expires_at")))


def _sweep(pdf: pd.DataFrame) -> pd.DataFrame:
    """Overlapping ranges of a segment as disjoint pieces, each with the largest seq of those that cover it."""
    starts = sorted(zip(pdf["lo"], pdf["hi"], pdf["seq"], strict=True), key=lambda r: r[0])
    bounds = sorted({*pdf["lo"], *pdf["hi"]})
    out, heap, k = [], [], 0
    for lo, hi in zip(bounds, bounds[1:]):
        while k < len(starts) and starts[k][0] <= lo:
            heapq.heappush(heap, (-starts[k][2], starts[k][1]))
            k += 1
        while heap and heap[0][1] <= lo:
            heapq.heappop(heap)
        if heap:
            out.append((lo, hi, -heap[0][0]))
    frame = pd.DataFrame(out, columns=["lo", "hi", "seq"])
    frame.insert(0, "segment", pdf["segment"].iloc[0])
    frame.insert(0, "cf", pdf["cf"].iloc[0])
    return frame


def uncovered(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows that no range delete [lo, hi) of their column family with a larger seq covers.

    Many ranges are spread over key segments, swept to disjoint pieces there, and put in one order of keys with the rows, where each row
    meets the last piece that begins at or before its key: no row tries every range, however many there are or overlap.
    """
    ranges = ranges.where("lo < hi").select("cf", "lo", "hi", "seq")
    if ranges.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        r = ranges.toDF("_cf", "_lo", "_hi", "_seq")
        inside = (F.col("cf") == F.col("_cf")) & (F.col("_lo") <= F.col("key")) & (F.col("key") < F.col("_hi")) & (F.col("_seq") > F.col("seq"))
        return rows.join(F.broadcast(r), inside, "left_anti")
    # segment bounds from a sample; every range goes to all segments that it touches, so the bounds only affect balance
    some = sorted({r[0] for r in ranges.select("lo").sample(fraction=min(1.0, 20 * SEGMENTS / ranges.count()), seed=11).collect()})
    cuts = some[:: max(1, len(some) // SEGMENTS)]
    bounds = F.array(*[F.lit(c) for c in cuts])
    segment = lambda c: F.size(F.filter(bounds, lambda b: b <= c))
    ship(rows.sparkSession)
    spread = ranges.withColumn("segment", F.explode(F.sequence(segment(F.col("lo")), segment(F.col("hi")))))
    kind = dict(ranges.dtypes)["lo"]
    pieces = spread.groupBy("cf", "segment").applyInPandas(_sweep, f"cf string, segment int, lo {kind}, hi {kind}, seq long")
    # a range has its pieces in every segment that it touches, so the rows of a segment need no others
    copies = pieces.select(F.col("cf").alias("_c"), F.col("segment").alias("_s"), F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("_t"), F.col("lo").alias("_k"), F.lit(0).alias("_late"), F.struct("hi", "seq").alias("_p"))
    all_ = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    late = rows.select(F.col("cf").alias("_c"), segment(F.col("key")).alias("_s"), salt.alias("_t"), F.col("key").alias("_k"), F.lit(1).alias("_late"), all_.alias("_row"))
    both = late.unionByName(copies, allowMissingColumns=True)
    order = Window.partitionBy("_c", "_s", "_t").orderBy("_k", "_late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_p", F.last("_p", ignorenulls=True).over(order)).where("_late = 1")
    return both.where(~F.coalesce((F.col("_k") < F.col("_p.hi")) & (F.col("_p.seq") > F.col("_row.seq")), F.lit(False))).select("_row.*")


def resolve(log: DataFrame, range_dels: DataFrame | None = None, seq: int | None = None, now: int | Column | None = None) -> DataFrame:
    """Live rows (cf, key, seq, value) after write ``seq`` at time ``now``."""
    rows = latest(as_of(log, seq)).where(is_live(now))
    if range_dels is not None:
        rows = uncovered(rows, as_of(range_dels, seq))
    return rows.select("cf", "key", "seq", "value")


def merge_layers(layers: list[DataFrame]) -> DataFrame:
    """Union of layers, newest first, each row with its layer as ``source_id``."""
    out = None
    for k, layer in enumerate(layers):
        layer = with_ord(layer).withColumn("source_id", F.lit(k))
        out = layer if out is None else out.unionByName(layer)
    if out is None:
        raise ValueError("no layers")
    return out
