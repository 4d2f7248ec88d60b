import asyncio
import datetime
import json
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from tidelog.functions.bloom import BloomFilter
from tidelog.functions.metrics import Metrics, counters, prometheus
from tidelog.operators.txn import ConflictError, WriteBatch
from tidelog.schema import LOG
from tidelog.sources.http import AsyncStore, serve
from tidelog.sources.store import CommitConflict, Compactor, Store, UnknownColumnFamily
from tidelog.streaming.replicate import FollowerBehind, catch_up, expiring_stream, latest_stream, replicate


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/db", ("default", "meta"), now=0)


def test_reopen(spark, store):
    store.put("a", "1")
    store.put("b", "2", "meta")
    store.delete("a")
    store.put_with_ttl("t", "x", 0, 5)
    again = Store.open(spark, store.path, now=0)
    assert (again.get("a"), again.get("b", "meta"), again.get("t"), again.write_seq()) == (None, "2", "x", 5)
    assert again.list_cfs() == ["default", "meta"]
    with pytest.raises(UnknownColumnFamily):
        again.put("k", "v", "nowhere")


def test_batch_ranges_compaction(store):
    b = WriteBatch()
    for i in range(10):
        b.put(f"log:{i:04d}", str(i))
    seq = store.write_batch(b)
    assert store.write_batch(WriteBatch()) is None
    with store.snapshots.register(seq):
        store.put("log:0000", "new")
        store.delete_range("log:0004", "log:0008")
        store.compact()
        assert [r.key[-1] for r in store.iterate().collect()] == list("012389")
        assert store.log().count() == 11
    store.compact()
    assert store.log().count() == 10
    assert [r.value for r in store.scan("log:0000", "log:0002").collect()] == ["new", "1"]
    assert store.stats().first().n_records == 10


def test_racing_writers(spark, store):
    other = Store.open(spark, store.path, now=0)
    store.put("a", "1")
    with pytest.raises(CommitConflict):
        other.put("a", "2")


def test_occ(store):
    store.put("account", "100")
    t = store.begin()
    assert t.get("account") == "100"
    t.put("account", "90")
    assert t.get("account") == "90"
    store.put("account", "50")
    with pytest.raises(ConflictError) as e:
        t.commit()
    assert e.value.keys == [("default", "account")]
    blind = store.begin()
    blind.put("account", "1")
    store.put("account", "2")
    blind.commit()
    assert store.get("account") == "1"


def test_replica_and_stream(spark, store, tmp_path):
    for i in range(3):
        store.put(f"k{i}", str(i))
    store.delete("k1")
    replica = Store(spark, f"file://{tmp_path}/replica", now=0)
    for _ in range(2):
        replicate(spark, store.path, replica, f"{tmp_path}/cp").awaitTermination()
    assert [(r.key, r.seq) for r in replica.iterate().collect()] == [("k0", 1), ("k2", 3)]
    store.put("k9", "9")
    replicate(spark, store.path, replica, f"{tmp_path}/cp").awaitTermination()
    assert replica.get("k9") == "9" and replica.write_seq() == store.write_seq()
    rows = spark.createDataFrame([("c", "k", i, 0, "put", str(i), 0) for i in (2, 1, 3)], LOG)
    rows.write.parquet(f"{tmp_path}/in")
    q = latest_stream(spark.readStream.schema(LOG).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.key, r.value) for r in spark.table("newest").collect()] == [("k", "3")]


def test_http_and_async(store):
    server = serve(store)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, method="GET", body=None):
        with urllib.request.urlopen(urllib.request.Request(base + path, method=method, data=body)) as r:
            text = r.read().decode()
        return text if path == "/metrics" else json.loads(text)

    assert call("/key/a%3A1", "PUT", b"x") == {"ok": True}
    assert call("/key/a:1") == {"key": "a:1", "value": "x"}
    assert call("/prefix/a:") == [{"key": "a:1", "value": "x"}] and call("/scan?from=a") == []
    assert call("/snapshot")["seq"] == 1 and call("/stats")[0]["n_keys"] == 1
    assert "kv_writes_total 1" in call("/metrics")
    call("/key/a:1", "DELETE")
    with pytest.raises(urllib.error.HTTPError) as e:
        call("/key/a:1")
    assert e.value.code == 404
    server.shutdown()
    a = AsyncStore(store)
    asyncio.run(a.put("z", "1"))
    assert asyncio.run(a.get("z")) == "1"


def test_metrics(spark):
    m = Metrics()
    m.record_write(100, 1000)
    m.record_read(True, 50, 0)
    m.record_read(False, 50, 3)
    m.record_compaction(5)
    m.record_bloom(True)
    m.record_bloom(False)
    with m.timer("write", 1):
        pass
    row = counters(m.frame(spark)).first()
    assert (row.writes_total, row.bytes_written_total, row.reads_total, row.read_hits_total, row.bytes_read_total, row.bloom_misses_total) == (2, 101, 2, 1, 50, 1)
    text = prometheus(m.frame(spark))
    assert 'kv_read_latency_ns_bucket{le="1"} 1' in text and text.count("# TYPE") == 11
    assert counters(Metrics().frame(spark)).first().writes_total == 0


def test_bloom(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    f = BloomFilter.build(keys)
    g = BloomFilter.from_bytes(f.to_bytes())
    assert g.may_contain([f"k{i}" for i in range(2000)]).all()
    assert g.may_contain([f"x{i}" for i in range(2000)]).mean() < 0.03
    one = BloomFilter(1)
    one.insert("a")
    assert one.bits == 64 and one.may_contain(["a"]).all()


def test_torn_commits_and_writers_that_die(spark, store):
    store.put("a", "1")
    n = len(store._commits)
    rows = spark.createDataFrame([("default", "x", 9, 0, "put", "lost", 0)], LOG)
    store._write(rows)  # died before its commit
    store._fs.create(store._file(n), False).close()  # torn
    again = Store(spark, store.path, ("default", "meta"), now=0)
    assert again.get("a") == "1" and again.get("x") is None
    again.put("b", "2")
    assert Store(spark, store.path, (), now=0).get("b") == "2"


def test_levels_vacuum_and_background(store):
    for i in range(9):
        store.put(f"k{i % 3}", str(i))
    store.delete("k0")
    want = [(r.key, r.value) for r in store.iterate().collect()]
    assert store.maintain() >= 1 and not store.levels()[0] and any(store.levels()[1:])
    assert [(r.key, r.value) for r in store.iterate().collect()] == want == [("k1", "7"), ("k2", "8")]
    assert store.log().count() == 2  # the tombstone went with the last level
    kept = store.cached_state()
    assert kept is store.cached_state() and kept.count() == 2
    assert store.vacuum() == [] and len(store.vacuum(0)) >= 10
    assert [(r.key, r.value) for r in store.iterate().collect()] == want
    with Compactor(store, 0.1) as worker:
        for i in range(5):
            store.put("z", str(i))
        for _ in range(100):
            if worker.jobs:
                break
            time.sleep(0.2)
    assert worker.jobs and not worker.errors
    assert store.get("z") == "4" and Store(store.spark, store.path, (), now=0)._commits == store._commits
    with pytest.raises(CommitConflict):
        store._commit({"kind": "compact", "folder": "compacted/none", "inputs": ["log/gone"], "level": 1, "seq": 1})
    assert kept is not store.cached_state()


def test_replica_of_range_deletes_expiry_and_lost_checkpoints(spark, store, tmp_path):
    for k in "abcd":
        store.put(k, k)
    store.put_with_ttl("e", "e", 500, 1000)
    store.delete_range("a", "c")
    store.put("a", "again")
    replica = Store(spark, f"file://{tmp_path}/replica", (), now=0)
    run = lambda k: replicate(spark, store.path, replica, f"{tmp_path}/cp{k}").awaitTermination()
    rows = lambda s: [(r.key, r.seq, r.value) for r in s.iterate().collect()]
    run(0)
    assert rows(replica) == rows(store) == [("a", 7, "again"), ("c", 3, "c"), ("d", 4, "d"), ("e", 5, "e")]
    replica.now = store.now = 2000
    assert [k for k, _, _ in rows(replica)] == ["a", "c", "d"]
    store.put("f", "f")
    n = len(replica._commits)
    run(1)  # a fresh checkpoint
    assert rows(replica) == rows(store) and len(replica._commits) == n + 1
    run(1)
    assert len(replica._commits) == n + 1 and replica.list_cfs() == store.list_cfs()
    store.put("g", "g")
    store.compact()
    store.vacuum(0)
    with pytest.raises(FollowerBehind):
        catch_up(spark, store.path, replica)


def test_state_that_expires(spark, tmp_path):
    schema = f"{LOG}, at timestamp"
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    batches = [
        [("c", "k", 1, 0, "ttl", "a", 20_000, at(10)), ("c", "p", 2, 0, "put", "b", 0, at(10))],
        [("c", "p", 1, 0, "put", "late", 0, at(15)), ("c", "q", 3, 0, "put", "x", 0, at(30))],
        [("c", "p", 4, 0, "del", None, 0, at(31))],
        [("c", "q", 5, 0, "put", "y", 0, at(60))],
        [("c", "r", 6, 0, "put", "z", 0, at(61))],
    ]
    seen = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = expiring_stream(stream, "at").writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((r.key, r.seq, r.state) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert ("k", 1, "live") in seen and ("k", 1, "expired") in seen and ("p", 2, "live") in seen and ("p", 4, "deleted") in seen and ("q", 5, "live") in seen
    assert not any(key == "p" and seq == 1 for key, seq, _ in seen)


def test_lookups_in_files_with_a_dictionary(spark, store):
    """An equality on a key is tested against the compressed dictionary of its files, and must find what is there."""
    keys = spark.range(4000).select(F.lit("default").alias("cf"), F.format_string("user:%04d:%d", F.col("id") % 500, F.col("id") % 7).alias("key"), F.lit("put").alias("op"), F.concat(F.lit("v#"), F.col("id").cast("string")).alias("value"), F.lit(0).cast("long").alias("expires_at"))
    store.write_frame(keys.coalesce(1).withColumn("ord", F.expr("cast(substring(value, 3) as int)")))
    want = max(i for i in range(4000) if i % 500 == 42 and i % 7 == 0)
    assert store.get("user:0042:0") == f"v#{want}"
    assert store.get("user:0042:9") is None
    store.compact()
    assert store.get("user:0042:0") == f"v#{want}"
