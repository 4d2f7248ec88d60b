"""Operation metrics as aggregates over an operation log, and their Prometheus text.

The operation log has (kind, bytes, ns, hit): kind 'write', 'read', 'compaction' or 'bloom'.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .codec import metric_bucket

OPS = "kind string, bytes long, ns long, hit boolean"
BUCKETS = 64
#: Counter names and what they count.
COUNTERS = {
    "writes_total": "Total number of write operations",
    "bytes_written_total": "Total bytes written",
    "reads_total": "Total number of read operations",
    "read_hits_total": "Total reads that found a value",
    "bytes_read_total": "Total bytes read",
    "compactions_total": "Total compactions",
    "bloom_hits_total": "Total bloom filter positives",
    "bloom_misses_total": "Total bloom filter negatives",
}
HISTOGRAMS = {"write": "write_latency_ns", "read": "read_latency_ns", "compaction": "compaction_latency_ns"}


def _sum(when: Column, x: Column | int = 1) -> Column:
    return F.coalesce(F.sum(F.when(when, x)), F.lit(0)).cast("long")


def counters(ops: DataFrame) -> DataFrame:
    """One row with all counters. Hits and bytes of reads count only where the read hit."""
    kind, hit = F.col("kind"), F.coalesce("hit", F.lit(False))
    return ops.agg(
        _sum(kind == "write").alias("writes_total"),
        _sum(kind == "write", F.col("bytes")).alias("bytes_written_total"),
        _sum(kind == "read").alias("reads_total"),
        _sum((kind == "read") & hit).alias("read_hits_total"),
        _sum((kind == "read") & hit, F.col("bytes")).alias("bytes_read_total"),
        _sum(kind == "compaction").alias("compactions_total"),
        _sum((kind == "bloom") & hit).alias("bloom_hits_total"),
        _sum((kind == "bloom") & ~hit).alias("bloom_misses_total"),
    )


def histogram(ops: DataFrame) -> DataFrame:
    """(kind, bucket, n): at most 64 buckets a kind."""
    return ops.where(F.col("kind").isin(*HISTOGRAMS)).groupBy("kind", metric_bucket(F.col("ns")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def prometheus(ops: DataFrame, prefix: str = "kv", compat: bool = False) -> str:
    """Counters and cumulative histograms. ``compat`` labels bucket i with 2^i; else with its true upper bound 2^(i+1) - 1."""
    values = counters(ops).first().asDict()
    lines = []
    for name, text in COUNTERS.items():
        lines += [f"# HELP {prefix}_{name} {text}", f"# TYPE {prefix}_{name} counter", f"{prefix}_{name} {values[name]}"]
    counts = {(r.kind, r.bucket): r.n for r in histogram(ops).collect()}
    for kind, name in HISTOGRAMS.items():
        lines += [f"# HELP {prefix}_{name} Latency of {kind} operations in nanoseconds", f"# TYPE {prefix}_{name} histogram"]
        total = 0
        for i in range(BUCKETS):
            total += counts.get((kind, i), 0)
            le = "+Inf" if i == BUCKETS - 1 else str(1 << i if compat else (1 << (i + 1)) - 1)
            lines.append(f'{prefix}_{name}_bucket{{le="{le}"}} {total}')
    return "\n".join(lines) + "\n"


class Metrics:
    """A recorder in the driver whose rows become an operation log."""

    def __init__(self):
        self.rows: list[tuple] = []

    def record_write(self, n_bytes: int, ns: int) -> None:
        self.rows.append(("write", n_bytes, ns, None))

    def record_read(self, hit: bool, n_bytes: int, ns: int) -> None:
        self.rows.append(("read", n_bytes, ns, hit))

    def record_compaction(self, ns: int) -> None:
        self.rows.append(("compaction", 0, ns, None))

    def record_bloom(self, hit: bool) -> None:
        self.rows.append(("bloom", 0, 0, hit))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, OPS)

    def timer(self, kind: str, n_bytes: int = 0, hit: bool = True) -> Timer:
        return Timer(self, kind, n_bytes, hit)


class Timer:
    """Records its block's duration when it ends."""

    def __init__(self, metrics: Metrics, kind: str, n_bytes: int, hit: bool):
        self.metrics, self.kind, self.n_bytes, self.hit = metrics, kind, n_bytes, hit

    def __enter__(self):
        self.began = time.perf_counter_ns()
        return self

    def __exit__(self, *exc):
        ns = time.perf_counter_ns() - self.began
        if self.kind == "write":
            self.metrics.record_write(self.n_bytes, ns)
        elif self.kind == "read":
            self.metrics.record_read(self.hit, self.n_bytes, ns)
        else:
            self.metrics.record_compaction(ns)


def record_all(metrics: Metrics, rows: Iterable[tuple]) -> None:
    metrics.rows.extend(rows)
