"""Sharding by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files) that never change. Shards are in tiers by size, each tier
``FANIN`` times the one before. Where a tier holds ``FANIN`` shards or more, its shards are merged in order of arrival into
files of up to the target size. Rows aren't shuffled: a merge reads whole shards, packed into tasks of the target size, and
each task writes one file. Every append and merge is committed as a new version of the manifest, which lists the shards
that hold the data. Data go to a folder of a name that no other writer has; the manifest is written whole under a name of its own
and then renamed to that of its version, which fails if the version exists. So readers see one version or the next, a failed
job leaves only unlisted files, a writer that dies at any point blocks nobody, and of two writers that race one commits and
the other, whose data stay its own, commits on the version after that (``append``) or starts anew (``compact``).

``vacuum`` deletes what no kept version lists: kept are the last version and those younger than ``KEEP_S`` seconds; folders
younger than that are left alone too, as their writer may be about to commit them.

Defined results: null and empty texts are rows as any other; an empty arrival commits a version without new shards; a set without
shards reads as no rows (of the columns that the caller names); rows that repeat are all kept; every column is stored as it is. The row
order within a shard is that of arrival.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, scratch_path

TARGET_BYTES = 128 << 20
FANIN = 4
#: The largest shard of the lowest tier.
SMALL_BYTES = 1 << 20
#: Shards of an arrival are cut at so many rows.
SHARD_ROWS = 2000
#: How long versions and unlisted folders are kept, and how often an append tries to commit.
KEEP_S = 24 * 3600
TRIES = 100


class ManifestConflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int  # the first arrival whose rows it holds

    def tier(self, small: int = SMALL_BYTES) -> int:
        k = 0
        while self.bytes > small:
            small *= FANIN
            k += 1
        return k


class ShardSet:
    """A folder of shards with its manifest."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES, shard_rows: int = SHARD_ROWS):
        self.spark, self.root, self.target, self.small, self.shard_rows = spark, root.rstrip("/"), target, small, shard_rows
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._fs_path(f"{self.root}/manifest"))

    def version(self) -> int:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._fs_path(f"{self.root}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._fs_path(f"{self.root}/manifest/v{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, version: int, shards: list[Shard]) -> int:
        """Write version + 1: first whole under a name of its own, then by a rename that fails if the version exists."""
        final = self._fs_path(f"{self.root}/manifest/v{version + 1}.json")
        own = self._fs_path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps({"version": version + 1, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # FileContext's rename doesn't overwrite
            context.rename(self._fs.makeQualified(own), self._fs.makeQualified(final), none)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(final):
                raise ManifestConflict(version + 1) from e
            raise
        return version + 1

    def _written(self, folder: str, arrival: int) -> list[Shard]:
        files = [f for f in self._fs.listStatus(self._fs_path(folder)) if f.getPath().getName().startswith("part-")]
        return [Shard(f.getPath().toString(), f.getLen(), arrival) for f in sorted(files, key=lambda f: f.getPath().getName())]

    def append(self, rows: DataFrame) -> int:
        """Commit the rows as new shards, after whatever others commit meanwhile."""
        folder = f"{self.root}/data/a{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.shard_rows).mode("errorifexists").parquet(folder)
        for left in range(TRIES, 0, -1):
            version = self.version()
            try:
                return self.commit(version, self.manifest(version) + self._written(folder, version + 1))
            except ManifestConflict:
                if left == 1:
                    raise
        raise AssertionError("unreachable")

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What to merge: of each tier below the target its shards, if they are FANIN or more, in order of arrival."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target // 2:
                tiers.setdefault(s.tier(self.small), []).append(s)
        return [sorted(t, key=lambda s: (s.arrival, s.path)) for _, t in sorted(tiers.items()) if len(t) >= FANIN]

    def compact(self) -> int:
        """Merge until no tier has a run to merge. Each merge is a commit; one that another writer overtakes starts anew."""
        vain: set[tuple[Shard, ...]] = set()  # runs whose files are as large as they get
        while True:
            version = self.version()
            shards = self.manifest(version)
            run = next((r for r in self.runs(shards) if tuple(r) not in vain), None)
            if run is None:
                return version
            conf = self.spark.conf
            keys = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
            before = {k: conf.get(k, None) for k in keys}
            folder = f"{self.root}/data/c{uuid.uuid4().hex}"
            try:
                for k, v in keys.items():
                    conf.set(k, v)
                rows = self.spark.read.parquet(*[s.path for s in run])
                rows.write.mode("errorifexists").parquet(folder)
            finally:
                for k, v in before.items():
                    conf.unset(k) if v is None else conf.set(k, v)
            merged, gone = self._written(folder, run[0].arrival), set(run)
            if len(merged) >= len(run):
                vain.add(tuple(run))
                self._fs.delete(self._fs_path(folder), True)
                continue
            try:
                self.commit(version, [s for s in shards if s not in gone] + merged)
            except ManifestConflict:
                self._fs.delete(self._fs_path(folder), True)

    def vacuum(self, keep_s: float = KEEP_S) -> None:
        """Delete versions and data that are older than keep_s seconds and that neither the last version nor a younger one needs."""
        version, until = self.version(), (time.time() - keep_s) * 1000
        manifests = {f.getPath().getName(): f for f in self._fs.listStatus(self._fs_path(f"{self.root}/manifest"))}
        kept = [int(n[1:-5]) for n, f in manifests.items() if n.startswith("v") and n.endswith(".json") and (n == f"v{version}.json" or f.getModificationTime() > until)]
        listed = {s.path for v in kept for s in self.manifest(v)}
        data = self._fs_path(f"{self.root}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            files = self._fs.listStatus(folder.getPath())
            if any(f.getPath().toString() in listed for f in files):
                for f in files:
                    if f.getPath().getName().startswith("part-") and f.getPath().toString() not in listed and f.getModificationTime() <= until:
                        self._fs.delete(f.getPath(), False)
            elif folder.getModificationTime() <= until:
                self._fs.delete(folder.getPath(), True)
        for name, f in manifests.items():
            if f.getModificationTime() <= until and name not in {f"v{v}.json" for v in kept}:
                self._fs.delete(f.getPath(), False)

    def read(self, version: int | None = None, out: tuple[str, str] = ("shard", "shard_bytes"), empty: DataFrame | None = None) -> DataFrame:
        """The rows of a version, with the number of their shard in the manifest and its size by the names in ``out``, which must be new. empty: whose columns a set without shards has."""
        shards = self.manifest(version)
        if not shards:
            base = self.spark.range(0).select() if empty is None else empty.limit(0)
            return base.select("*", F.lit(0).alias(out[0]), F.lit(0).cast("long").alias(out[1]))
        rows = self.spark.read.parquet(*[s.path for s in shards])
        (name,) = fresh([*rows.columns, *out], "_name")
        names = self.spark.createDataFrame([(s.path.rsplit("/", 2)[1] + "/" + s.path.rsplit("/", 1)[1], k, s.bytes) for k, s in enumerate(shards)], f"`{name}` string, `{out[0]}` int, `{out[1]}` long")
        rows = rows.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1))
        return rows.join(F.broadcast(names) if len(shards) <= BROADCAST_ROWS else names, name).drop(name)


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """docs cut by id into n batches; ranges of ids, so that the scan of each batch reads only its part. Null ids come first."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    cuts = [low + (high - low + 1) * k // n for k in range(1, n)]
    out = []
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        own = F.lit(True)
        if a is not None:
            own = own & (F.col("doc_id") >= a)
        if b is not None:
            own = own & (F.col("doc_id") < b)
        if a is None:
            own = F.col("doc_id").isNull() | own
        out.append(docs.where(own))
    return out


def shard_documents(docs: DataFrame, root: str | None = None, batches: int = 4, target: int = TARGET_BYTES) -> ShardSet:
    """Append docs in batches, compact, and drop what is no longer listed."""
    spark = docs.sparkSession
    shards = ShardSet(spark, root or scratch_path(spark, "shards"), target)
    for rows in arrivals(docs, batches):
        shards.append(rows)
    shards.compact()
    if root is None:  # nobody else reads it
        shards.vacuum(0)
    else:
        shards.vacuum()
    return shards


def placement(docs: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """doc_id, source, lang, n_chars, shard, shard_bytes for every document, read back from the committed shards."""
    if docs.isEmpty():
        return docs.select("doc_id", "source", "lang", "n_chars", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    shard, size = fresh(docs.columns, "shard", "shard_bytes")
    rows = shard_documents(docs, target=target).read(out=(shard, size))
    return rows.select("doc_id", "source", "lang", "n_chars", F.col(shard).alias("shard"), F.col(size).alias("shard_bytes"))
