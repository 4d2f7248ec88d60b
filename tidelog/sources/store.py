"""A Parquet-backed store: an append-only log under a folder, with commits that are atomic and numbered.

A write is a Parquet job into a folder that nothing lists yet, followed by a commit file under the next number: written whole
under a name of its own and then renamed, which fails if another writer has that number. A reader lists the commits and reads the
folders they name, up to the first commit that is missing or torn (which only a file system that breaks its promises can leave);
the next writer takes that number again. Rows are
sorted by key within column-family partitions, so that point, range and prefix reads prune by row-group statistics, and
Parquet Bloom filters on the key serve point reads.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, reads
from ..operators.resolve import resolve
from ..operators.txn import OccTransaction, Snapshot, SnapshotRegistry, WriteBatch
from ..schema import DEFAULT_CF, LOG, RANGE_DEL
from .wal import with_crc


class UnknownColumnFamily(KeyError):
    pass


class CommitConflict(Exception):
    """Another writer has taken the commit number."""


class Store:
    def __init__(self, spark: SparkSession, path: str, cfs: tuple[str, ...] = (DEFAULT_CF,), now=None, expected_keys: int = 1_000_000):
        self.spark, self.path, self.now, self.expected_keys = spark, path.rstrip("/"), now, expected_keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/commits"))
        self.snapshots = SnapshotRegistry()
        self._commits: list[dict] = []
        self._lock = threading.RLock()  # of the commits that this object knows: a Compactor works beside its owner
        self._torn = False  # the file of the next number can't be read
        self._kept: tuple[int, DataFrame] | None = None
        self._refresh()
        for cf in cfs:
            self.create_cf(cf)

    @classmethod
    def open(cls, spark: SparkSession, path: str, cfs: tuple[str, ...] = (DEFAULT_CF,), **kw) -> Store:
        return cls(spark, path, cfs, **kw)

    # commits

    def _file(self, n: int):
        return self._path(f"{self.path}/commits/{n:012d}.json")

    def _refresh(self) -> None:
        with self._lock:
            self._read_commits()

    def _read_commits(self) -> None:
        names = {f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/commits"))}
        self._torn = False
        while (name := f"{len(self._commits):012d}.json") in names:
            stream = self._fs.open(self._file(len(self._commits)))
            try:
                self._commits.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            except ValueError:
                self._torn = True
                return
            finally:
                stream.close()

    def _commit(self, entry: dict) -> None:
        with self._lock:
            if entry["kind"] == "compact" and not set(entry["inputs"]) <= set(self._folders("log")):
                raise CommitConflict("its inputs were compacted meanwhile")
            self._write_commit(entry)

    def _write_commit(self, entry: dict) -> None:
        n, jvm = len(self._commits), self.spark._jvm
        own = self._path(f"{self.path}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, int(self._torn))
        if self._torn:
            options[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(own), self._fs.makeQualified(self._file(n)), options)
        except Exception as e:
            self._fs.delete(own, False)
            if self._fs.exists(self._file(n)):
                raise CommitConflict(n) from e
            raise
        self._torn = False
        self._commits.append(entry)

    def _folders(self, kind: str) -> list[str]:
        live: list[str] = []
        for c in self._commits:
            if c["kind"] == kind:
                live.append(c["folder"])
            elif c["kind"] == "compact" and kind == "log":
                live = [f for f in live if f not in c["inputs"]] + [c["folder"]]
        return live

    # families and numbers

    def list_cfs(self) -> list[str]:
        return sorted({c["cf"] for c in self._commits if c["kind"] == "create_cf"})

    def create_cf(self, cf: str) -> None:
        if cf not in self.list_cfs():
            self._commit({"kind": "create_cf", "cf": cf, "seq": self.write_seq() - 1})

    def write_seq(self) -> int:
        return max((c["seq"] for c in self._commits), default=0) + 1

    def _known(self, *cfs: str) -> None:
        for cf in cfs:
            if cf not in self.list_cfs():
                raise UnknownColumnFamily(cf)

    # writes

    def _write(self, rows: DataFrame, kind: str = "log") -> str:
        """kind: log, compacted (which followers don't tail) or range_del."""
        folder = f"{kind}/batch=b{uuid.uuid4().hex}"
        out = rows.write if kind == "range_del" else with_crc(rows).sortWithinPartitions("cf", "key", "seq", "ord").write.partitionBy("cf")
        if kind != "range_del":
            out = out.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.expected.ndv#key", str(self.expected_keys)).option("compression", "zstd")
        out.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, rows: DataFrame, last_seq: int) -> None:
        """Rows in the log's columns with seqs of their own, the largest being last_seq, as one commit."""
        self._known(*[r.cf for r in rows.select("cf").distinct().collect()])
        self._commit({"kind": "log", "folder": self._write(rows), "seq": last_seq})

    def write_frame(self, rows: DataFrame) -> int:
        """Rows (cf, key, op, value, expires_at) under one seq, as one commit; for bulk loads of any size."""
        seq = self.write_seq()
        rows = rows.withColumn("seq", F.lit(seq).cast("long")).withColumn("ord", F.lit(0) if "ord" not in rows.columns else F.col("ord"))
        self.append(rows.select("cf", "key", "seq", "ord", "op", "value", "expires_at"), seq)
        return seq

    def write_batch(self, batch: WriteBatch) -> int | None:
        if batch.is_empty():
            return None
        self._known(*{e[0] for e in batch.entries})
        seq = self.write_seq()
        self._commit({"kind": "log", "folder": self._write(batch.frame(self.spark, seq).coalesce(1)), "seq": seq})
        return seq

    def put(self, key, value, cf: str = DEFAULT_CF) -> int:
        return self.write_batch(WriteBatch().put(key, value, cf))

    def put_with_ttl(self, key, value, ttl_ms: int, now: int, cf: str = DEFAULT_CF) -> int:
        """ttl_ms 0: never expires."""
        self._known(cf)
        seq = self.write_seq()
        rows = self.spark.createDataFrame([(cf, key, seq, 0, "ttl", value, now + ttl_ms if ttl_ms else 0)], LOG)
        self._commit({"kind": "log", "folder": self._write(rows.coalesce(1)), "seq": seq})
        return seq

    def delete(self, key, cf: str = DEFAULT_CF) -> int:
        return self.write_batch(WriteBatch().delete(key, cf))

    def delete_range(self, lo, hi, cf: str = DEFAULT_CF) -> int:
        self._known(cf)
        seq = self.write_seq()
        self._commit({"kind": "range_del", "folder": self._write(self.spark.createDataFrame([(cf, lo, hi, seq)], RANGE_DEL).coalesce(1), "range_del"), "seq": seq})
        return seq

    def append_ranges(self, ranges: DataFrame, last_seq: int) -> None:
        """Range deletes (cf, lo, hi, seq) in bulk, as one commit."""
        self._known(*[r.cf for r in ranges.select("cf").distinct().collect()])
        self._commit({"kind": "range_del", "folder": self._write(ranges.select("cf", "lo", "hi", "seq"), "range_del"), "seq": last_seq})

    # reads

    def log(self) -> DataFrame:
        self._refresh()
        return self._read(self._folders("log"))

    def _read(self, folders) -> DataFrame:
        out = self.spark.createDataFrame([], LOG) if not folders else None
        for root in ("compacted", "log"):
            own = [f"{self.path}/{f}" for f in folders if f.startswith(f"{root}/")]
            if own:
                rows = self.spark.read.schema(f"{LOG}, crc long").option("basePath", f"{self.path}/{root}").parquet(*own)
                rows = rows.select("cf", "key", "seq", "ord", "op", "value", "expires_at")
                out = rows if out is None else out.unionByName(rows)
        return out

    def cached_state(self) -> DataFrame:
        """Live rows kept in Spark's cache until the next commit, for many reads of one state. Expiry is judged when they are cached."""
        self._refresh()
        if self._kept is None or self._kept[0] != len(self._commits):
            if self._kept is not None:
                self._kept[1].unpersist()
            self._kept = (len(self._commits), resolve(self.log(), self.ranges(), None, self.now).persist())
        return self._kept[1]

    def ranges(self) -> DataFrame | None:
        folders = [f"{self.path}/{f}" for f in self._folders("range_del")]
        return self.spark.read.schema(RANGE_DEL).parquet(*folders) if folders else None

    def get(self, key, cf: str = DEFAULT_CF):
        self._known(cf)
        row = reads.get(self.log(), key, cf, self.ranges(), None, self.now).first()
        return None if row is None else row.value

    def scan(self, lo, hi, cf: str = DEFAULT_CF) -> DataFrame:
        self._known(cf)
        return reads.scan(self.log(), lo, hi, cf, self.ranges(), None, self.now)

    def scan_prefix(self, prefix, cf: str = DEFAULT_CF) -> DataFrame:
        self._known(cf)
        return reads.scan_prefix(self.log(), prefix, cf, self.ranges(), None, self.now)

    def iterate(self, cf: str = DEFAULT_CF) -> DataFrame:
        self._known(cf)
        return reads.iterate(self.log(), cf, self.ranges(), None, self.now)

    def snapshot(self, cf: str = DEFAULT_CF) -> Snapshot:
        self._known(cf)
        return Snapshot(self.log(), self.write_seq() - 1, self.ranges(), self.now, cf)

    def begin(self) -> OccTransaction:
        return OccTransaction(self, self.now)

    def stats(self) -> DataFrame:
        return reads.cf_stats(self.log())

    # maintenance

    def compact(self) -> None:
        """Rewrite the log without versions that no registered snapshot nor a new reader can see, sorted by range of keys."""
        inputs = self._folders("log")
        if not inputs:
            return
        rows = compaction.retain_for_snapshots(self.log(), sorted(self.snapshots.active)).repartitionByRange("cf", "key")
        self._commit({"kind": "compact", "folder": self._write(rows, "compacted"), "inputs": inputs, "level": 1, "seq": self.write_seq() - 1})

    def levels(self) -> list[list[tuple[str, int]]]:
        """(folder, bytes) by level: what was written is level 0, oldest first; a compaction says which level it made."""
        self._refresh()
        of = {c["folder"]: c.get("level", 1) for c in self._commits if c["kind"] == "compact"}
        out: list[list[tuple[str, int]]] = [[] for _ in range(compaction.LEVELS)]
        for f in self._folders("log"):
            out[of.get(f, 0)].append((f, int(self._fs.getContentSummary(self._path(f"{self.path}/{f}")).getLength())))
        return out

    def run_job(self) -> compaction.Job | None:
        """Carry out the compaction that the level policy asks for, if any: its inputs become one folder of its target level."""
        job = compaction.find_job(self.levels())
        if job is None:
            return None
        rows = compaction.compact(self._read(job.inputs), sorted(self.snapshots.active), drop_tombstones=job.drop_tombstones and not self._folders("range_del"))
        folder = self._write(rows.repartitionByRange("cf", "key"), "compacted")
        self._commit({"kind": "compact", "folder": folder, "inputs": list(job.inputs), "level": job.target, "seq": self.write_seq() - 1})
        return job

    def maintain(self) -> int:
        """Jobs until the policy asks for none; how many there were."""
        n = 0
        while self.run_job() is not None:
            n += 1
        return n

    def vacuum(self, keep_s: float = 24 * 3600) -> list[str]:
        """Delete data folders older than keep_s seconds that no commit lists any more: inputs of compactions, and what died before its commit."""
        self._refresh()
        live = {*self._folders("log"), *self._folders("range_del")}
        until, gone = (time.time() - keep_s) * 1000, []
        for kind in ("log", "compacted", "range_del"):
            root = self._path(f"{self.path}/{kind}")
            for f in self._fs.listStatus(root) if self._fs.exists(root) else []:
                folder = f"{kind}/{f.getPath().getName()}"
                if folder not in live and f.getModificationTime() <= until:
                    self._fs.delete(f.getPath(), True)
                    gone.append(folder)
        return gone


class Compactor:
    """Runs a store's compactions in the background, one at a time, whenever the policy asks for one."""

    def __init__(self, store: Store, every_s: float = 1.0):
        self.store, self.every_s, self.jobs, self.errors = store, every_s, 0, []
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.is_set():
            try:
                self.jobs += self.store.maintain()
            except CommitConflict:
                pass  # a writer was faster: the next turn sees its commit
            except Exception as e:
                self.errors.append(e)
            self._stop.wait(self.every_s)

    def __enter__(self) -> Compactor:
        self._thread.start()
        return self

    def __exit__(self, *exc) -> None:
        self._stop.set()
        self._thread.join()
