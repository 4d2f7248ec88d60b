import random
import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions.codec import be_u64, djb2_hash, fnv1a_hash, le_i64, metric_bucket
from tidelog.operators import compaction, merge, reads, resolve, txn
from tidelog.schema import LATEST, LOG, RANGE_DEL
from tidelog.sources import wal

MAX, MIN = (1 << 63) - 1, -(1 << 63)


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def live(df):
    return [(r.key, r.value) for r in df.collect()]


def put(key, seq, value, cf="default", ord=0):
    return (cf, key, seq, ord, "put", value, 0)


def delete(key, seq, cf="default", ord=0):
    return (cf, key, seq, ord, "del", None, 0)


def test_overwrite_and_tombstone(spark):
    log = log_of(spark, [put("a", 1, "1"), put("b", 2, "2"), put("a", 3, "3"), delete("b", 4)])
    assert live(reads.iterate(log, now=0)) == [("a", "3")]
    assert [tuple(r) for r in reads.lookup_state(log, "b").collect()] == [("tombstone", 4, None)]
    assert reads.lookup_state(log, "zz").first().state == "absent"


def test_scan_is_half_open_and_sorted(spark):
    log = log_of(spark, [put(f"key:{i:02d}", i + 1, f"val:{i}") for i in random.Random(1).sample(range(10), 10)])
    assert [k for k, _ in live(reads.scan(log, "key:03", "key:07", now=0))] == [f"key:0{i}" for i in range(3, 7)]
    assert live(reads.scan(log, "key:07", "key:03", now=0)) == [] == live(reads.scan(log, "key:03", "", now=0))


def test_prefix(spark):
    log = log_of(spark, [put("user:alice", 1, "a"), put("user:bob", 2, "b"), put("order:001", 3, "c")])
    assert [k for k, _ in live(reads.scan_prefix(log, "user:", now=0))] == ["user:alice", "user:bob"]
    assert len(live(reads.scan_prefix(log, "", now=0))) == 3
    assert reads.successor(b"a\xff") == b"b" and reads.successor(b"\xff") is None


def test_families_are_apart(spark):
    log = log_of(spark, [put("k", 1, "x"), put("k", 2, "y", "meta")])
    assert live(reads.get(log, "k", "meta", now=0)) == [("k", "y")]
    assert [r.cf for r in reads.list_cfs(log).collect()] == ["default", "meta"]


@pytest.mark.parametrize("now,want", [(99, ["v"]), (100, []), (101, [])])
def test_ttl_boundary(spark, now, want):
    log = log_of(spark, [("default", "k", 1, 0, "put", "old", 0), ("default", "k", 2, 0, "ttl", "v", 100)])
    assert [v for _, v in live(reads.get(log, "k", now=now))] == want  # an expired version doesn't uncover an older one


def test_range_delete(spark):
    log = log_of(spark, [put(f"log:{i:04d}", i + 1, f"entry-{i}") for i in range(10)] + [put("log:0005", 12, "again")])
    ranges = spark.createDataFrame([("default", "log:0004", "log:0008", 11), ("meta", "log:0000", "log:9999", 99), ("default", "log:0002", "log:0002", 99)], RANGE_DEL)
    assert [k[-1] for k, _ in live(reads.iterate(log, range_dels=ranges, now=0))] == list("0123589")


def test_many_range_deletes_take_the_segment_path(spark, monkeypatch):
    log = log_of(spark, [put(f"k{i:03d}", i + 1, "v") for i in range(200)])
    ranges = spark.createDataFrame([("default", f"k{i:03d}", f"k{i + 7:03d}", 500) for i in range(0, 200, 20)], RANGE_DEL)
    want = sorted(live(resolve.resolve(log, ranges, now=0).select("key", "value")))
    monkeypatch.setattr(resolve, "FEW_RANGES", 3)
    monkeypatch.setattr(resolve, "SEGMENTS", 4)
    assert sorted(live(resolve.resolve(log, ranges, now=0).select("key", "value"))) == want and len(want) == 130


def test_snapshot_reads(spark):
    log = log_of(spark, [put("k", 1, "v1"), put("k", 2, "v2"), put("j", 3, "x")])
    snap = txn.Snapshot(log, 1, now=0)
    assert (snap.get("k"), snap.get("j"), snap.key_count()) == ("v1", None, 1)


def test_batch_ties_go_to_the_later_entry(spark):
    b = txn.WriteBatch().put("k", "1").delete("k").put("k", "2").put("j", "x")
    assert live(reads.iterate(b.frame(spark, 7), now=0)) == [("j", "x"), ("k", "2")] and len(b) == 4


@pytest.mark.parametrize("deltas,base,want", [([1, 2, 3], None, 6), ([5, -3], 10, 12), ([1], MAX, MIN), ([MIN, -1], None, MAX), ([MAX] * 5, None, (5 * MAX + (1 << 63)) % (1 << 64) - (1 << 63))])
def test_counters_wrap(spark, deltas, base, want):
    d = spark.createDataFrame([("c", "k", x) for x in deltas], "cf string, key string, delta long")
    b = None if base is None else spark.createDataFrame([("c", "k", base)], "cf string, key string, value long")
    assert merge.int64_add(d, b).first().value == want
    packed = [struct.pack("<q", x) for x in deltas]
    assert struct.unpack("<q", merge.Int64Add().full_merge(b"k", None if base is None else struct.pack("<q", base), packed))[0] == want


def test_append_and_fold(spark):
    rows = [("c", "k", 3, 0, "fast"), ("c", "k", 1, 0, ""), ("c", "k", 2, 0, "rust")]
    d = spark.createDataFrame(rows, "cf string, key string, seq long, ord int, delta string")
    assert merge.string_append(d).first().value == "rust,fast"
    base = spark.createDataFrame([("c", "k", "existing")], "cf string, key string, value string")
    assert merge.string_append(d, " | ", base).first().value == "existing |  | rust | fast"
    binary = d.select("cf", F.col("key").cast("binary").alias("key"), "seq", "ord", F.col("delta").cast("binary").alias("delta"))
    assert bytes(merge.fold(binary, merge.StringAppend()).first().value) == b"rust,fast"
    state = merge.MergeState(b"k", None, merge.Int64Add())
    assert state.resolve() is None and merge.Int64Add().partial_merge(b"k", b"x", b"y") is None


def test_retain_versions(spark):
    log = log_of(spark, [put("k", 5, "a"), put("k", 15, "b"), put("k", 25, "c"), delete("t", 5)])
    seqs = lambda df: sorted((r.key, r.seq) for r in df.collect())
    assert seqs(compaction.retain_versions(log, 10)) == [("k", 15), ("k", 25), ("t", 5)]
    assert seqs(compaction.retain_versions(log, 10, deepest=True)) == [("k", 15), ("k", 25)]
    assert seqs(compaction.retain_for_snapshots(log, [10, 20])) == [("k", 5), ("k", 15), ("k", 25), ("t", 5)]
    assert (compaction.safe_horizon([]), compaction.safe_horizon([20, 10]), compaction.safe_horizon([0])) == (LATEST, 9, 0)


def test_registry_counts_each_seq_once():
    r = txn.SnapshotRegistry()
    with r.register(10), r.register(10), r.register(20):
        assert (r.active_count(), r.safe_horizon()) == (2, 9)
    assert r.active_count() == 0


def test_filters(spark):
    log = spark.createDataFrame([("keep:1", 1, "x"), ("drop:1", 2, "y"), ("drop:2", 3, None)], "key string, seq long, value string")
    assert sorted(r.key for r in compaction.apply_filter(log, compaction.prefix_drop("drop:")).collect()) == ["drop:2", "keep:1"]
    up = compaction.function_filter(lambda k, v: compaction.Filter(replace=k.startswith("keep"), value=F.upper(v)))
    assert {r.key: (r.seq, r.value) for r in compaction.apply_filter(log, up).collect()}["keep:1"] == (1, "X")
    now = 1_000_000
    rows = [("past", bytearray(struct.pack(">Q", now - 1000))), ("future", bytearray(struct.pack(">Q", now + 1))), ("never", bytearray(8)), ("short", bytearray(b"abc")), ("huge", bytearray(b"\xff" * 8))]
    stamped = spark.createDataFrame([(k, 1, v) for k, v in rows], "key string, seq long, value binary")
    assert sorted(r.key for r in compaction.apply_filter(stamped, compaction.expiry_prefix(now)).collect()) == ["future", "huge", "never", "short"]


def test_merge_entries_is_positional(spark):
    schema = "key string, seq long, value string"
    newer = spark.createDataFrame([("a", 1, "new"), ("b", 2, None)], schema)
    older = spark.createDataFrame([("a", 9, "old"), ("b", 8, "x"), ("c", 7, "y")], schema)
    assert sorted(tuple(r) for r in compaction.merge_entries(newer, older, True).collect()) == [("a", 1, "new"), ("c", 7, "y")]


def test_level_policy():
    assert compaction.find_job([[("f", 1)] * 4, [], []]).drop_tombstones
    assert compaction.find_job([[("f", 1)] * 3]) is None
    job = compaction.find_job([[], [("a", 2 << 20)], [("b", 5)]])
    assert (job.level, job.inputs, job.drop_tombstones) == (1, ("a", "b"), False)


def test_wal_prefix_and_manifest(spark):
    rows = wal.with_crc(log_of(spark, [put("a", 1, "x"), put("b", 2, None), put("c", 3, ""), put("d", 4, "y", "meta")]))
    bad = rows.withColumn("crc", F.when(F.col("seq") == 2, F.col("crc") + 1).otherwise(F.col("crc")))
    assert sorted(r.seq for r in wal.valid_prefix(rows).collect()) == [1, 2, 3, 4]
    assert sorted(r.seq for r in wal.valid_prefix(bad).collect()) == [1, 4]
    acts = spark.createDataFrame([(1, "c", 0, "f1", "add"), (2, "c", 0, "f2", "add"), (3, "c", 0, "f1", "remove"), (3, "c", 1, "f3", "add"), (4, "c", None, None, "create_cf")], "batch_id long, cf string, level int, filename string, action string")
    assert sorted((r.filename, r.level) for r in wal.replay_manifest(acts).collect()) == [("f2", 0), ("f3", 1)]


def test_codecs(spark):
    row = spark.createDataFrame([(bytearray(struct.pack("<q", -5)), bytearray(b"\xff" * 8), 0, 1024, (1 << 53) - 1)], "a binary, b binary, c long, d long, e long")
    got = row.select(le_i64(F.col("a")), be_u64(F.col("b")), *[metric_bucket(F.col(c)) for c in "cde"]).first()
    assert tuple(got) == (-5, (1 << 64) - 1, 0, 10, 52)
    assert int(fnv1a_hash(["a"])[0]) == 0xAF63DC4C8601EC8C and int(djb2_hash(["a"])[0]) == 177670


def test_random_mutations_match_a_dict(spark):
    r = random.Random(3)
    rows, ranges = [], []
    for seq in range(1, 400):
        k = f"k{r.randrange(30):02d}"
        op = r.choice(["put", "put", "ttl", "del", "range"])
        if op == "range":
            ranges.append(("default", k, f"k{r.randrange(31):02d}", seq))
        else:
            rows.append(("default", k, seq, 0, op, None if op == "del" else str(seq), r.choice([0, 50, 150]) if op == "ttl" else 0))
    for bound in (100, 399):
        want = {}
        for seq, row in sorted([(x[2], x) for x in rows] + [(x[3], x) for x in ranges], key=lambda t: t[0]):
            if seq > bound:
                break
            if len(row) == 4:
                want = {k: v for k, v in want.items() if not row[1] <= k < row[2]}
            else:
                want[row[1]] = row
        want = {k: v[5] for k, v in want.items() if v[4] != "del" and (v[6] == 0 or 100 < v[6])}
        got = dict(live(resolve.resolve(log_of(spark, rows), spark.createDataFrame(ranges, RANGE_DEL), bound, 100).select("key", "value")))
        assert got == want


def test_range_deletes_against_every_range(spark, monkeypatch):
    """Overlapping and nested ranges of several families, by pieces and by trying each."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 4)))
    rows = [(r.choice(["c", "d"]), word() if k % 3 else "hot" + str(k % 2), k, "v") for k in range(400)]
    ranges = [(r.choice(["c", "d"]), *sorted((word(), word())), r.randrange(400)) for _ in range(90)]
    want = sorted(x for x in rows if not any(c == x[0] and lo <= x[1] < hi and s > x[2] for c, lo, hi, s in ranges))
    a, b = spark.createDataFrame(rows, "cf string, key string, seq long, value string"), spark.createDataFrame(ranges, RANGE_DEL)
    for few in (64, 1000):
        monkeypatch.setattr(resolve, "FEW_RANGES", few)
        assert sorted(tuple(x) for x in resolve.uncovered(a, b).collect()) == want
    monkeypatch.setattr(resolve, "FEW_RANGES", 0)
    binary = lambda df, *cs: df.select(*[F.col(c).cast("binary").alias(c) if c in cs else c for c in df.columns])
    assert resolve.uncovered(binary(a, "key"), binary(b, "lo", "hi")).count() == len(want)


def test_conflicts_and_retention_never_pair_versions(spark):
    """The plans hold no join, and agree with counting by hand on a hot key."""
    rows = [put("k", s, "v") for s in range(1, 300)] + [put("m", 300, "v")]
    log = log_of(spark, rows)
    tx = spark.createDataFrame([(i, "default", "k", 10 * i, 10 * i + 25) for i in range(20)] + [(99, "default", "none", 1, 5), (98, "default", "k", 50, 40)], "tx long, cf string, key string, horizon long, commit long")
    for stretch in (1, 7, 1000):  # a hot key's order may be cut anywhere
        got = {r.tx: r.n_conflicts for r in txn.conflicts(tx, log, stretch).collect()}
        assert got == {i: sum(10 * i < s <= 10 * i + 25 for s in range(1, 300)) for i in range(20)} | {99: 0, 98: 0}
    kept = {(r.key, r.seq) for r in compaction.retain_for_snapshots(log, [5, 100, 1000]).collect()}
    assert kept == {("k", 5), ("k", 100), ("k", 299), ("m", 300)}
    assert {(r.key, r.seq) for r in compaction.retain_versions(log, 290).collect()} == {("k", s) for s in range(291, 300)} | {("m", 300)}
    for df in (txn.conflicts(tx, log), compaction.retain_for_snapshots(log, [5]), compaction.retain_versions(log, 9, True)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan
