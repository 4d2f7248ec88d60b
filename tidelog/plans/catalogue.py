"""The query catalogue: each operator applied to the whole log of the event table, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bloom import BloomFilter
from ..functions.codec import be_u64, djb2, fnv1a, le_i64
from ..functions.metrics import counters, histogram, prometheus
from ..operators import compaction, merge, reads, resolve, txn
from ..scratch import scratch_path
from ..sources import wal
from ..sources.events import kv_log, kv_range_del
from ..sources.store import Store
from ..streaming.replicate import expiring_stream, latest_stream, replicate, tail

#: 2024-01-31T00:00:00Z.
NOW = 1706659200000


def _batched(s, d):
    log = kv_log(s, d)
    return log.withColumn("ord", ((F.col("seq") - 1) % 10).cast("int")).withColumn("seq", F.expr("(seq - 1) div 10 + 1"))


def _keys(s, d):
    return kv_log(s, d).where("cf = 'default'").select("key").distinct().where(F.col("key").endswith(":3"))


def _layers(s, d):
    per_key = lambda cf: kv_log(s, d).where(F.col("cf") == cf).groupBy("key").agg(F.max("seq").alias("seq"), F.max("value").alias("value"))
    return per_key("meta"), per_key("default")


def _line_ops(s, d):
    """An operation log from the line items: writes, reads that hit by return flag, and their times."""
    li = s.read.parquet(f"{d}/lineitem.parquet")
    return li.select(
        F.when(F.col("l_linenumber") % 3 == 0, "write").when(F.col("l_linenumber") % 3 == 1, "read").otherwise("bloom").alias("kind"),
        F.col("l_partkey").alias("bytes"),
        (F.col("l_orderkey") * 997 + 1).alias("ns"),
        (F.col("l_returnflag") == "R").alias("hit"),
    )


def _manifest(s, d):
    """Adds and removes of 40 file names a family, over and over; a batch may do both to a file."""
    log = kv_log(s, d).select("cf", ((F.col("seq") - 1) % 50).alias("f"), F.expr("(seq - 1) div 50").alias("b"))
    adds = log.select(F.col("b").alias("batch_id"), "cf", F.lit(0).alias("level"), F.concat(F.lit("f"), (F.col("b") % 40).cast("string")).alias("filename"), F.when(F.col("f") % 2 == 0, "add").otherwise("remove").alias("action"))
    return adds.distinct()


def _crc_log(s, d):
    rows = wal.with_crc(kv_log(s, d))
    return rows.withColumn("crc", F.when(F.col("seq") % 4001 == 4000, F.col("crc") + 1).otherwise(F.col("crc")))


def _stamped(s, d):
    """Values that start with an 8-byte big-endian time: 0, past or future."""
    at = F.when(F.col("seq") % 3 == 0, F.lit(0)).when(F.col("seq") % 3 == 1, F.lit(NOW - 1000)).otherwise(F.lit(NOW + 60000)).cast("long")
    rows = resolve.latest(kv_log(s, d)).withColumn("at", at)
    packed = F.when(F.col("op") != "del", F.concat(F.unhex(F.lpad(F.hex("at"), 16, "0")), F.col("value").cast("binary")))
    return rows.select("cf", "key", "seq", packed.alias("value"))


def _bloom(s, d):
    keys = kv_log(s, d).where("cf = 'default'").select("key").distinct()
    f = BloomFilter.build(keys)
    probes = keys.union(keys.select(F.concat("key", F.lit("?")).alias("key")))
    return probes.select("key", (~F.col("key").endswith("?")).alias("present"), f.probe(F.col("key")).alias("may_contain"))


def _store(s, d, parts: int = 5) -> Store:
    """A store of its own with the whole log, written in so many commits, and its range deletes."""
    store = Store(s, scratch_path(s, "store"), ("default", "meta"), now=NOW)
    log = kv_log(s, d)
    top = reads.write_seq(log) - 1
    for k in range(parts):
        low, high = top * k // parts, top * (k + 1) // parts
        store.append(log.where((F.col("seq") > low) & (F.col("seq") <= high)), high)
    store.append_ranges(kv_range_del(s, d), top)
    return store


def _live(store: Store):
    return resolve.resolve(store.log(), store.ranges(), now=NOW)


def _compacted(s, d):
    store = _store(s, d)
    store.maintain()
    return _live(store)


def _snapshot(s, d):
    """A snapshot registered before the log is compacted sees what it saw."""
    store = _store(s, d)
    with store.snapshots.register(5000):
        store.maintain()
        return txn.Snapshot(store.log(), 5000, None, NOW).rows()


def _replica(s, d):
    store = _store(s, d)
    replica = Store(s, scratch_path(s, "replica"), (), now=NOW)
    replicate(s, store.path, replica, scratch_path(s, "stream")).awaitTermination()
    return _live(replica)


def _streamed(s, d):
    source, out = scratch_path(s, "log"), scratch_path(s, "latest")
    kv_log(s, d).write.parquet(source)
    stream = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    latest_stream(stream).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", scratch_path(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


def _tailed(s, d):
    store, out = _store(s, d), scratch_path(s, "tailed")
    tail(s, store.path).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out).drop("ord")


def _expiring(s, d):
    """What the state of a stream tells of the whole log: every key's newest version, then what the last event time lets expire."""
    source, out = scratch_path(s, "log"), scratch_path(s, "states")
    at = s.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("seq"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"))
    kv_log(s, d).join(at, "seq").withColumn("at", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.parquet(source)
    stream = s.readStream.schema(s.read.parquet(source).schema).parquet(source)
    expiring_stream(stream, "at").writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).option("checkpointLocation", scratch_path(s, "stream")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


def _reopened(s, d):
    return _live(Store.open(s, _store(s, d).path, (), now=NOW))


def _vacuumed(s, d):
    store = _store(s, d)
    store.compact()
    store.vacuum(keep_s=0)
    return _live(store)


def _ranged(s, d):
    store = _store(s, d)
    store.delete_range("user:0010", "user:0020")
    return _live(store)


def _expiries(s, d):
    """Writes that expire later, at the moment of reading, and never."""
    store = _store(s, d)
    for key, value, ttl in (("user:0042:1", "later", 60000), ("user:0042:2", "over", 1000), ("user:0042:3", "never", 0)):
        store.put_with_ttl(key, value, ttl, NOW - 1000)
    return _live(store)


def _transactions(s, d):
    """Two transactions read one key; the first to commit wins, the other is refused and leaves nothing."""
    store = _store(s, d)
    first, second = store.begin(), store.begin()
    for tx in (first, second):
        tx.get("user:0042:1")
    first.put("user:0042:1", "draft")
    first.put("user:0042:1", "final")
    first.delete("user:0042:2")
    first.commit()
    second.put("user:0042:1", "lost")
    try:
        second.commit()
        refused = False
    except txn.ConflictError:
        refused = True
    return _live(store).withColumn("refused", F.lit(refused))


def _layered(s, d):
    log = kv_log(s, d)
    layers = [log.where("seq > 700"), log.where("seq > 200 AND seq <= 700"), log.where("seq <= 200")]
    return resolve.latest(resolve.merge_layers(layers)).select("cf", "key", "seq", "source_id", "value")


def _folded_counter(s, d):
    """Counters as 8 little-endian bytes, folded by the operator on bytes."""
    delta = F.unhex(F.when(F.col("op") == "del", F.lit("F" * 16)).otherwise(F.lit("01" + "0" * 14)))
    rows = kv_log(s, d).select("cf", F.col("key").cast("binary").alias("key"), "seq", "ord", delta.alias("delta"))
    return merge.fold(rows, merge.Int64Add()).select("cf", F.col("key").cast("string").alias("key"), le_i64(F.col("value")).alias("n"))


def _folded(s, d):
    put = kv_log(s, d).where("op = 'put'").select("cf", F.col("key").cast("binary").alias("key"), "seq", "ord", F.col("value").cast("binary").alias("delta"))
    return merge.fold(put, merge.StringAppend()).select("cf", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _partial(s, d):
    """Deltas merged in parts first, then the parts with each other."""
    delta = kv_log(s, d).select("cf", "key", (F.col("seq") % 4).alias("part"), F.when(F.col("op") == "del", -1).otherwise(1).cast("long").alias("delta"))
    parts = delta.groupBy("cf", "key", "part").agg(merge.wrapped_sum(F.col("delta")).alias("delta"))
    return merge.int64_add(parts).withColumnRenamed("value", "n")


def _prometheus(s, d):
    lines = [x.rsplit(" ", 1) for x in prometheus(_line_ops(s, d)).splitlines() if not x.startswith("#")]
    return s.createDataFrame([(name, int(v)) for name, v in lines], "name string, value long")


def _hashes(s, d):
    keys = kv_log(s, d).select("key").distinct()
    return keys.select("key", fnv1a(F.col("key")).alias("fnv1a"), djb2(F.col("key")).alias("djb2"))


def queries() -> dict:
    live = lambda s, d: resolve.resolve(kv_log(s, d), now=NOW)
    hist = lambda s, d: histogram(_line_ops(s, d).withColumn("kind", F.lit("read"))).select(F.col("bucket").cast("long").alias("bucket"), "n")
    return {
        "kv_log": lambda s, d: kv_log(s, d).drop("ord"),
        "latest": lambda s, d: resolve.latest(kv_log(s, d)).drop("ord"),
        "live": live,
        "live_range_deleted": lambda s, d: resolve.resolve(kv_log(s, d), kv_range_del(s, d), now=NOW),
        "snapshot_5000": lambda s, d: resolve.resolve(kv_log(s, d), seq=5000, now=NOW),
        "snapshot_range_deleted": lambda s, d: resolve.resolve(kv_log(s, d), kv_range_del(s, d), seq=5000, now=NOW),
        "get": lambda s, d: reads.get(kv_log(s, d), "user:0042:1", now=NOW),
        "lookup_state": lambda s, d: reads.lookup_state(kv_log(s, d), "user:0042:1"),
        "multi_get": lambda s, d: reads.multi_get(kv_log(s, d), _keys(s, d), now=NOW),
        "scan_range": lambda s, d: reads.scan(kv_log(s, d), "user:0010", "user:0020", now=NOW),
        "scan_prefix": lambda s, d: reads.scan_prefix(kv_log(s, d), "user:0042:", now=NOW),
        "iterate": lambda s, d: reads.iterate(kv_log(s, d), None, now=NOW),
        "merge_string_append": lambda s, d: merge.string_append(kv_log(s, d).where("op = 'put'").withColumnRenamed("value", "delta")),
        "merge_counter": lambda s, d: merge.int64_add(kv_log(s, d).select("cf", "key", F.when(F.col("op") == "del", -1).otherwise(1).cast("long").alias("delta"))).withColumnRenamed("value", "n"),
        "merge_counter_wrapping": lambda s, d: merge.int64_add(kv_log(s, d).select("cf", "key", (F.col("seq") * 0 + ((1 << 63) - 1)).alias("delta"))),
        "gc_reference_rule": lambda s, d: compaction.retain_versions(kv_log(s, d), 4999).select("cf", "key", "seq", "op", "value"),
        "gc_deepest": lambda s, d: compaction.retain_versions(kv_log(s, d), 4999, deepest=True).select("cf", "key", "seq", "op", "value"),
        "gc_snapshot_safe": lambda s, d: compaction.retain_for_snapshots(kv_log(s, d), [5000, 8000]).select("cf", "key", "seq"),
        "occ_conflicts": lambda s, d: txn.conflicts(kv_log(s, d).where("seq % 50 = 0").select(F.col("seq").alias("tx"), "cf", "key", F.col("seq").alias("horizon"), (F.col("seq") + 200).alias("commit")), kv_log(s, d)),
        "group_commit": lambda s, d: wal.group_commit(kv_log(s, d), 100),
        "compaction_filter": lambda s, d: compaction.apply_filter(resolve.latest(kv_log(s, d)), compaction.Filter(F.col("value").startswith("view"), F.col("value").startswith("click"), F.lit("clicked"))).select("cf", "key", "seq", "value"),
        "prefix_drop_filter": lambda s, d: compaction.apply_filter(resolve.latest(kv_log(s, d)), compaction.prefix_drop("user:00")).select("cf", "key", "seq", "value"),
        "expiry_prefix_filter": lambda s, d: compaction.apply_filter(_stamped(s, d), compaction.expiry_prefix(NOW)).select("cf", "key", "seq", F.hex("value").alias("value_hex")),
        "cf_stats": lambda s, d: reads.cf_stats(kv_log(s, d)),
        "list_cfs": lambda s, d: reads.list_cfs(kv_log(s, d)),
        "key_write_seq": lambda s, d: reads.key_write_seq(kv_log(s, d)),
        "write_seq": lambda s, d: s.createDataFrame([(reads.write_seq(kv_log(s, d)),)], "write_seq long"),
        # every 50th commit is taken for a snapshot that a reader holds; the rule is part of the question, as in occ_conflicts
        "safe_horizon": lambda s, d: compaction.horizon_of(kv_log(s, d).where("seq % 50 = 0")),
        "write_batch": lambda s, d: resolve.latest(_batched(s, d)).where("op <> 'del'").select("cf", "key", "seq", F.col("ord").cast("long").alias("ord"), "value"),
        "merge_entries": lambda s, d: compaction.merge_entries(*_layers(s, d), drop_tombstones=True),
        "wal_valid_prefix": lambda s, d: wal.valid_prefix(_crc_log(s, d)).select("cf", "key", "seq"),
        "manifest_replay": lambda s, d: wal.replay_manifest(_manifest(s, d)),
        "latency_histogram": hist,
        "metrics_counters": lambda s, d: counters(_line_ops(s, d)),
        "bloom_probe": _bloom,
        "key_hashes": _hashes,
        "store_live": lambda s, d: _live(_store(s, d)),
        "store_compacted": _compacted,
        "store_snapshot": _snapshot,
        "replica_live": _replica,
        "stream_latest": _streamed,
        "stream_tail": _tailed,
        "stream_expiring": _expiring,
        "store_reopened": _reopened,
        "store_vacuumed": _vacuumed,
        "store_range_deleted": _ranged,
        "store_ttl": _expiries,
        "store_transactions": _transactions,
        "store_stats": lambda s, d: _store(s, d).stats(),
        "store_scan": lambda s, d: _store(s, d).scan("user:0010", "user:0020"),
        "snapshot_prefix": lambda s, d: _store(s, d).snapshot().scan_prefix("user:0042:"),
        "compacted_log": lambda s, d: compaction.compact(kv_log(s, d), (), drop_tombstones=True, now=NOW).select("cf", "key", "seq", "op", "value"),
        "merge_layers": _layered,
        "fold_counter": _folded_counter,
        "fold_string_append": _folded,
        "merge_counter_partial": _partial,
        "function_filter": lambda s, d: compaction.apply_filter(resolve.latest(kv_log(s, d)), compaction.function_filter(lambda key, value: compaction.Filter(value.startswith("view") & key.endswith(":3"), key.endswith(":4"), F.concat(value, F.lit("!"))))).select("cf", "key", "seq", "value"),
        "prometheus": _prometheus,
        "counter_codec": lambda s, d: kv_log(s, d).select("seq", le_i64(F.unhex(F.lpad(F.hex(F.col("seq")), 16, "0"))).alias("le"), be_u64(F.unhex(F.lpad(F.hex(F.col("seq")), 16, "0"))).cast("long").alias("be")),
    }


_LOG = r"""
WITH kv_log AS (SELECT event_id + 1 AS seq, CASE WHEN event_type = 'signup' THEN 'meta' ELSE 'default' END AS cf,
  concat('user:', lpad(CAST(user_id AS VARCHAR), 4, '0'), ':', CAST(event_id % 7 AS VARCHAR)) AS key,
  CASE event_type WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'ttl' ELSE 'put' END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat(event_type, '#', CAST(event_id AS VARCHAR)) END AS value,
  CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 + 604800000 ELSE CAST(0 AS BIGINT) END AS expires_at FROM events),
kv_range_del AS (SELECT event_id + 1 AS seq, 'default' AS cf, concat('user:', lpad(CAST(user_id AS VARCHAR), 4, '0')) AS lo,
  concat('user:', lpad(CAST(user_id + 3 AS VARCHAR), 4, '0')) AS hi FROM events WHERE event_id % 400 = 399),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS rn FROM kv_log),
latest AS (SELECT cf, key, seq, op, value, expires_at FROM ranked WHERE rn = 1),
live AS (SELECT cf, key, seq, value FROM latest WHERE op <> 'del' AND (expires_at = 0 OR 1706659200000 < expires_at)),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC) AS r FROM kv_log WHERE seq <= 5000) WHERE r = 1 AND op <> 'del' AND (expires_at = 0 OR 1706659200000 < expires_at))
"""


#: Distinct keys and, for the Bloom filter, keys that aren't there, with both hashes as unsigned 64-bit numbers.
_HASHES = r"""
, names AS (SELECT DISTINCT key, true AS present FROM kv_log UNION ALL SELECT DISTINCT key || '?', false FROM kv_log),
bytes AS (SELECT key, present, list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substring(key, CAST(i AS BIGINT), 1)) AS UHUGEINT)) AS b FROM names),
hashed AS (SELECT key, present,
  list_reduce(list_prepend(CAST('14695981039346656037' AS UHUGEINT), b), lambda h, x: (CAST(xor(CAST(h AS UBIGINT), CAST(x AS UBIGINT)) AS UHUGEINT) * 1099511628211) % CAST('18446744073709551616' AS UHUGEINT)) AS f,
  list_reduce(list_prepend(CAST(5381 AS UHUGEINT), b), lambda h, x: (h * 33 + x) % CAST('18446744073709551616' AS UHUGEINT)) AS j FROM bytes)
"""
_BLOOM_SQL = r"""
, own AS (SELECT key, present, f, j FROM hashed WHERE rtrim(key, '?') IN (SELECT key FROM kv_log WHERE cf = 'default')),
size AS (SELECT greatest(64, CAST(floor(count(*) * CAST(9.585 AS DOUBLE)) AS BIGINT)) AS bits FROM own WHERE present),
places AS (SELECT key, present, ((f + i * j) % CAST('18446744073709551616' AS UHUGEINT)) % CAST(bits AS UHUGEINT) AS spot FROM own, size, (SELECT CAST(unnest(range(7)) AS UHUGEINT) AS i)),
filled AS (SELECT DISTINCT spot FROM places WHERE present)
SELECT p.key, p.present, bool_and(s.spot IS NOT NULL) AS may_contain FROM places p LEFT JOIN filled s ON p.spot = s.spot GROUP BY p.key, p.present
"""
_PROMETHEUS_SQL = r"""
WITH o AS (SELECT l_linenumber % 3 AS k, l_partkey AS b, l_returnflag = 'R' AS h, length(bin(l_orderkey * 997 + 1)) - 1 AS bucket FROM lineitem),
c AS (SELECT count(*) FILTER (k = 0) AS writes_total, CAST(coalesce(sum(b) FILTER (k = 0), 0) AS BIGINT) AS bytes_written_total, count(*) FILTER (k = 1) AS reads_total, count(*) FILTER (k = 1 AND h) AS read_hits_total,
  CAST(coalesce(sum(b) FILTER (k = 1 AND h), 0) AS BIGINT) AS bytes_read_total, CAST(0 AS BIGINT) AS compactions_total, count(*) FILTER (k = 2 AND h) AS bloom_hits_total, count(*) FILTER (k = 2 AND NOT h) AS bloom_misses_total FROM o),
n AS (SELECT unnest([0, 1, 9]) AS k, unnest(['write', 'read', 'compaction']) AS kind), i AS (SELECT unnest(range(64)) AS i)
SELECT 'kv_' || name AS name, value FROM (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'kv_' || kind || '_latency_ns_bucket{le="' || CASE WHEN i = 63 THEN '+Inf' ELSE CAST((1::HUGEINT << CAST(i + 1 AS INTEGER)) - 1 AS VARCHAR) END || '"}', (SELECT count(*) FROM o WHERE o.k = n.k AND o.bucket <= i.i) FROM n, i
"""


def oracle_sql() -> dict[str, str]:
    uncovered = "NOT EXISTS (SELECT 1 FROM kv_range_del r WHERE r.cf = l.cf AND r.lo <= l.key AND l.key < r.hi AND r.seq > l.seq{})"
    sql = {
        "kv_log": "SELECT cf, key, seq, op, value, expires_at FROM kv_log",
        "latest": "SELECT * FROM latest",
        "live": "SELECT * FROM live",
        "live_range_deleted": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "snapshot_5000": "SELECT cf, key, seq, value FROM old",
        "snapshot_range_deleted": f"SELECT cf, key, seq, value FROM old l WHERE {uncovered.format(' AND r.seq <= 5000')}",
        "get": "SELECT * FROM live WHERE cf = 'default' AND key = 'user:0042:1'",
        "lookup_state": "SELECT CASE WHEN count(*) = 0 THEN 'absent' WHEN max(op) = 'del' THEN 'tombstone' ELSE 'value' END AS state, max(seq) AS seq, max(value) AS value FROM latest WHERE cf = 'default' AND key = 'user:0042:1'",
        "multi_get": "SELECT * FROM live WHERE cf = 'default' AND key LIKE '%:3'",
        "scan_range": "SELECT * FROM live WHERE cf = 'default' AND key >= 'user:0010' AND key < 'user:0020'",
        "scan_prefix": "SELECT * FROM live WHERE cf = 'default' AND starts_with(key, 'user:0042:')",
        "iterate": "SELECT * FROM live",
        "merge_string_append": "SELECT cf, key, string_agg(value, ',' ORDER BY seq) AS value FROM kv_log WHERE op = 'put' GROUP BY cf, key",
        "merge_counter": "SELECT cf, key, CAST(sum(CASE WHEN op = 'del' THEN -1 ELSE 1 END) AS BIGINT) AS n FROM kv_log GROUP BY cf, key",
        "merge_counter_wrapping": "SELECT cf, key, CAST(CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END AS BIGINT) AS value FROM (SELECT cf, key, (count(*) * 9223372036854775807::HUGEINT) % 18446744073709551616::HUGEINT AS m FROM kv_log GROUP BY cf, key)",
        "gc_reference_rule": "SELECT cf, key, seq, op, value FROM ranked WHERE rn = 1 OR seq > 4999",
        "gc_deepest": "SELECT r.cf, r.key, r.seq, r.op, r.value FROM ranked r JOIN latest l ON r.cf = l.cf AND r.key = l.key WHERE (r.rn = 1 OR r.seq > 4999) AND NOT (l.op = 'del' AND l.seq <= 4999)",
        "gc_snapshot_safe": "SELECT cf, key, seq FROM (SELECT *, lead(seq) OVER (PARTITION BY cf, key ORDER BY seq) AS nxt FROM kv_log) WHERE nxt IS NULL OR (seq <= 5000 AND nxt > 5000) OR (seq <= 8000 AND nxt > 8000)",
        "occ_conflicts": "SELECT t.seq AS tx, count(w.seq) AS n_conflicts FROM kv_log t LEFT JOIN kv_log w ON w.cf = t.cf AND w.key = t.key AND w.seq > t.seq AND w.seq <= t.seq + 200 WHERE t.seq % 50 = 0 GROUP BY t.seq",
        "group_commit": "SELECT (seq - 1) // 100 AS generation, count(*) AS n_records, min(seq) AS first_seq, max(seq) AS last_seq FROM kv_log GROUP BY 1",
        "compaction_filter": "SELECT cf, key, seq, CASE WHEN starts_with(value, 'click') THEN 'clicked' ELSE value END AS value FROM latest WHERE value IS NULL OR NOT starts_with(value, 'view')",
        "prefix_drop_filter": "SELECT cf, key, seq, value FROM latest WHERE value IS NULL OR NOT starts_with(key, 'user:00')",
        "expiry_prefix_filter": "SELECT cf, key, seq, upper(lpad(hex(CASE WHEN seq % 3 = 0 THEN 0 ELSE 1706659260000 END), 16, '0')) || hex(value) AS value_hex FROM latest WHERE value IS NULL OR seq % 3 <> 1",
        "cf_stats": "SELECT cf, count(*) AS n_records, count(DISTINCT key) AS n_keys, CAST(sum(CASE WHEN op = 'del' THEN 1 ELSE 0 END) AS BIGINT) AS n_tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS n_bytes, max(seq) AS max_seq FROM kv_log GROUP BY cf",
        "list_cfs": "SELECT DISTINCT cf FROM kv_log",
        "key_write_seq": "SELECT cf, key, max(seq) AS write_seq FROM kv_log GROUP BY cf, key",
        "write_seq": "SELECT max(seq) + 1 AS write_seq FROM kv_log",
        "safe_horizon": "SELECT coalesce(greatest(min(seq) - 1, 0), 9223372036854775807) AS horizon FROM kv_log WHERE seq % 50 = 0",
        "write_batch": "SELECT cf, key, seq, ord, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY seq DESC, ord DESC) AS r FROM (SELECT cf, key, op, value, (seq - 1) // 10 + 1 AS seq, (seq - 1) % 10 AS ord FROM kv_log)) WHERE r = 1 AND op <> 'del'",
        "merge_entries": "SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src) AS r FROM (SELECT 0 AS src, key, max(seq) AS seq, max(value) AS value FROM kv_log WHERE cf = 'meta' GROUP BY key UNION ALL SELECT 1 AS src, key, max(seq) AS seq, max(value) AS value FROM kv_log WHERE cf = 'default' GROUP BY key)) WHERE r = 1 AND value IS NOT NULL",
        "wal_valid_prefix": "SELECT l.cf, l.key, l.seq FROM kv_log l LEFT JOIN (SELECT cf, min(seq) AS bad FROM kv_log WHERE seq % 4001 = 4000 GROUP BY cf) b ON l.cf = b.cf WHERE b.bad IS NULL OR l.seq < b.bad",
        "manifest_replay": "SELECT cf, level, filename FROM (SELECT *, row_number() OVER (PARTITION BY cf, filename ORDER BY batch_id DESC, action) AS r FROM (SELECT DISTINCT (seq - 1) // 50 AS batch_id, cf, 0 AS level, 'f' || CAST(((seq - 1) // 50) % 40 AS VARCHAR) AS filename, CASE WHEN ((seq - 1) % 50) % 2 = 0 THEN 'add' ELSE 'remove' END AS action FROM kv_log)) WHERE r = 1 AND action = 'add'",
        "latency_histogram": "SELECT CAST(length(bin(l_orderkey * 997 + 1)) - 1 AS BIGINT) AS bucket, count(*) AS n FROM lineitem GROUP BY 1",
        "metrics_counters": "SELECT count(*) FILTER (k = 0) AS writes_total, CAST(sum(b) FILTER (k = 0) AS BIGINT) AS bytes_written_total, count(*) FILTER (k = 1) AS reads_total, count(*) FILTER (k = 1 AND h) AS read_hits_total, CAST(sum(b) FILTER (k = 1 AND h) AS BIGINT) AS bytes_read_total, CAST(0 AS BIGINT) AS compactions_total, count(*) FILTER (k = 2 AND h) AS bloom_hits_total, count(*) FILTER (k = 2 AND NOT h) AS bloom_misses_total FROM (SELECT l_linenumber % 3 AS k, l_partkey AS b, l_returnflag = 'R' AS h FROM lineitem)",
        "store_live": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "store_compacted": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "store_snapshot": "SELECT cf, key, seq, value FROM old WHERE cf = 'default'",
        "replica_live": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "stream_latest": "SELECT * FROM latest",
        "stream_tail": "SELECT cf, key, seq, op, value, expires_at FROM kv_log",
        "stream_expiring": "SELECT cf, key, seq, value, CASE WHEN op = 'del' THEN 'deleted' ELSE 'live' END AS state FROM latest UNION ALL SELECT cf, key, seq, value, 'expired' FROM latest WHERE expires_at > 0 AND expires_at <= (SELECT max(epoch_us(ts) // 1000) FROM events)",
        "store_reopened": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "store_vacuumed": f"SELECT * FROM live l WHERE {uncovered.format('')}",
        "store_range_deleted": f"SELECT * FROM live l WHERE {uncovered.format('')} AND NOT (cf = 'default' AND key >= 'user:0010' AND key < 'user:0020')",
        "store_ttl": f"SELECT * FROM live l WHERE {uncovered.format('')} AND NOT (cf = 'default' AND key IN ('user:0042:1', 'user:0042:2', 'user:0042:3')) UNION ALL SELECT 'default', 'user:0042:1', max(seq) + 1, 'later' FROM kv_log UNION ALL SELECT 'default', 'user:0042:3', max(seq) + 3, 'never' FROM kv_log",
        "store_transactions": f"SELECT *, true AS refused FROM live l WHERE {uncovered.format('')} AND NOT (cf = 'default' AND key IN ('user:0042:1', 'user:0042:2')) UNION ALL SELECT 'default', 'user:0042:1', max(seq) + 1, 'final', true FROM kv_log",
        "store_stats": "SELECT cf, count(*) AS n_records, count(DISTINCT key) AS n_keys, CAST(sum(CASE WHEN op = 'del' THEN 1 ELSE 0 END) AS BIGINT) AS n_tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0) + 16) AS BIGINT) AS n_bytes, max(seq) AS max_seq FROM kv_log GROUP BY cf",
        "store_scan": f"SELECT * FROM live l WHERE {uncovered.format('')} AND cf = 'default' AND key >= 'user:0010' AND key < 'user:0020'",
        "snapshot_prefix": f"SELECT * FROM live l WHERE {uncovered.format('')} AND cf = 'default' AND starts_with(key, 'user:0042:')",
        "compacted_log": "SELECT cf, key, seq, op, value FROM latest WHERE op <> 'del' AND (expires_at = 0 OR 1706659200000 < expires_at)",
        "merge_layers": "SELECT cf, key, seq, CASE WHEN seq > 700 THEN 0 WHEN seq > 200 THEN 1 ELSE 2 END AS source_id, value FROM latest",
        "fold_counter": "SELECT cf, key, CAST(sum(CASE WHEN op = 'del' THEN -1 ELSE 1 END) AS BIGINT) AS n FROM kv_log GROUP BY cf, key",
        "fold_string_append": "SELECT cf, key, string_agg(value, ',' ORDER BY seq) AS value FROM kv_log WHERE op = 'put' GROUP BY cf, key",
        "merge_counter_partial": "SELECT cf, key, CAST(sum(CASE WHEN op = 'del' THEN -1 ELSE 1 END) AS BIGINT) AS n FROM kv_log GROUP BY cf, key",
        "function_filter": "SELECT cf, key, seq, CASE WHEN key LIKE '%:4' THEN value || '!' ELSE value END AS value FROM latest WHERE value IS NULL OR NOT (starts_with(value, 'view') AND key LIKE '%:3')",
        "prometheus": _PROMETHEUS_SQL,
        "key_hashes": _HASHES + "SELECT key, CAST(CASE WHEN f >= 9223372036854775808 THEN CAST(f AS HUGEINT) - 18446744073709551616 ELSE CAST(f AS HUGEINT) END AS BIGINT) AS fnv1a, CAST(CASE WHEN j >= 9223372036854775808 THEN CAST(j AS HUGEINT) - 18446744073709551616 ELSE CAST(j AS HUGEINT) END AS BIGINT) AS djb2 FROM (SELECT key, f, j FROM hashed) WHERE NOT ends_with(key, '?')",
        "bloom_probe": _HASHES + _BLOOM_SQL,
        "counter_codec": "SELECT seq, CAST((seq % 256) * 72057594037927936::HUGEINT + ((seq // 256) % 256) * 281474976710656 + ((seq // 65536) % 256) * 1099511627776 - CASE WHEN seq % 256 >= 128 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS le, seq AS be FROM kv_log",
    }
    return {k: (_LOG + v if "FROM lineitem" not in v else v) for k, v in sql.items()}
