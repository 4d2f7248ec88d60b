"""Batches, snapshots and optimistic transactions."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_CF, LOG
from . import reads
from .compaction import safe_horizon
from .resolve import is_live, latest

#: Seqs of a stretch in which ``conflicts`` counts the reads and writes of a key.
STRETCH = 1 << 20


class WriteBatch:
    """Puts and deletes that share one seq; of entries for one key the last wins."""

    def __init__(self):
        self.entries: list[tuple] = []

    def put(self, key, value, cf: str = DEFAULT_CF) -> WriteBatch:
        self.entries.append((cf, key, "put", value))
        return self

    def delete(self, key, cf: str = DEFAULT_CF) -> WriteBatch:
        self.entries.append((cf, key, "del", None))
        return self

    def __len__(self) -> int:
        return len(self.entries)

    def is_empty(self) -> bool:
        return not self.entries

    def frame(self, spark: SparkSession, seq: int) -> DataFrame:
        return spark.createDataFrame([(cf, k, seq, i, op, v, 0) for i, (cf, k, op, v) in enumerate(self.entries)], LOG)


class Snapshot:
    """Reads of the log as it was after ``seq``; lazy, so it costs nothing until read."""

    def __init__(self, log: DataFrame, seq: int, ranges: DataFrame | None = None, now=None, cf: str = DEFAULT_CF):
        self.log, self.seq, self.ranges, self.now, self.cf = log, seq, ranges, now, cf

    def rows(self) -> DataFrame:
        return reads.iterate(self.log, self.cf, self.ranges, self.seq, self.now)

    def get(self, key) -> str | None:
        row = reads.get(self.log, key, self.cf, self.ranges, self.seq, self.now).first()
        return None if row is None else row.value

    def scan_prefix(self, prefix) -> DataFrame:
        return reads.scan_prefix(self.log, prefix, self.cf, self.ranges, self.seq, self.now)

    def key_count(self) -> int:
        return self.rows().count()


class SnapshotRegistry:
    """The set of sequence numbers that readers hold."""

    def __init__(self):
        self.active: dict[int, int] = {}

    @contextmanager
    def register(self, seq: int):
        self.active[seq] = self.active.get(seq, 0) + 1
        try:
            yield seq
        finally:
            self.active[seq] -= 1
            if not self.active[seq]:
                del self.active[seq]

    def active_count(self) -> int:
        return len(self.active)

    def safe_horizon(self) -> int:
        return safe_horizon(list(self.active))


class ConflictError(Exception):
    def __init__(self, keys: list[tuple[str, str]]):
        super().__init__(f"conflicting keys: {keys}")
        self.keys = keys


class OccTransaction:
    """Reads are remembered, writes are buffered; commit fails if a key that was read has been written since."""

    def __init__(self, store, now=None):
        self.store, self.now = store, now
        self.horizon = store.write_seq() - 1
        self.read_set: set[tuple[str, str]] = set()
        self.batch = WriteBatch()

    def get(self, key, cf: str = DEFAULT_CF):
        self.read_set.add((cf, key))
        for c, k, _, v in reversed(self.batch.entries):
            if (c, k) == (cf, key):
                return v
        return Snapshot(self.store.log(), self.horizon, self.store.ranges(), self.now, cf).get(key)

    def put(self, key, value, cf: str = DEFAULT_CF) -> None:
        self.batch.put(key, value, cf)

    def delete(self, key, cf: str = DEFAULT_CF) -> None:
        self.batch.delete(key, cf)

    def commit(self) -> int | None:
        if self.read_set:
            spark = self.store.spark
            keys = spark.createDataFrame(sorted(self.read_set), "cf string, key string")
            found = self.store.log().where(F.col("seq") > self.horizon).join(F.broadcast(keys), ["cf", "key"], "left_semi").select("cf", "key").distinct().collect()
            if found:
                raise ConflictError(sorted((r.cf, r.key) for r in found))
        return self.store.write_batch(self.batch)


def conflicts(reads_: DataFrame, log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Validate many transactions at once. reads_ (tx, cf, key, horizon, commit): (tx, n_conflicts), later writes to keys read.

    Writes and reads of a key are put in one order, where a running count gives how many writes there are up to a read's commit
    and up to its horizon; the difference is what it conflicts with. Reads and writes are never paired. The order is cut in stretches
    of ``stretch`` seqs, which are counted apart and start from the writes of all stretches before: a hot key is as many tasks' work.
    """
    writes = log.select("cf", "key", F.col("seq").alias("at"), F.lit(None).cast(reads_.schema["tx"].dataType).alias("tx"), F.lit(0).alias("sign"))
    marks = F.explode(F.array(F.struct(F.col("commit").alias("at"), F.lit(1).alias("sign")), F.struct(F.least("horizon", "commit").alias("at"), F.lit(-1).alias("sign"))))
    both = writes.unionByName(reads_.select("cf", "key", "tx", marks.alias("m")).select("cf", "key", "m.at", "tx", "m.sign"))
    both = both.withColumn("part", F.floor(F.col("at") / F.lit(stretch))).withColumn("writes", F.when(F.col("sign") == 0, 1).otherwise(0).cast("long"))
    before = Window.partitionBy("cf", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("cf", "key", "part").agg(F.sum("writes").alias("writes"))
    sums = sums.withColumn("writes", F.coalesce(F.sum("writes").over(before), F.lit(0)))
    # a stretch's own order begins with one row that counts for all before it
    both = both.unionByName(sums.withColumn("sign", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("cf", "key", "part").orderBy(F.col("at").asc_nulls_first(), F.abs("sign")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("n", F.sum("writes").over(order)).where("sign <> 0")
    return both.groupBy("tx").agg(F.sum(F.col("n") * F.col("sign")).cast("long").alias("n_conflicts"))


__all__ = ["ConflictError", "OccTransaction", "Snapshot", "SnapshotRegistry", "WriteBatch", "conflicts", "is_live", "latest"]
