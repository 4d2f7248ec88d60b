import random

import pytest
from pyspark.sql import functions as F

from tidelog.llm import sharding


def rows_of(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_two_appenders_at_one_version(spark, tmp_path, monkeypatch):
    a, b = (sharding.ShardSet(spark, f"file://{tmp_path}/s") for _ in range(2))
    commit = a.commit

    def late(version, shards):
        monkeypatch.setattr(a, "commit", commit)
        b.append(rows_of(spark, 100, 110))  # commits between a's write and its commit
        return commit(version, shards)

    monkeypatch.setattr(a, "commit", late)
    a.append(rows_of(spark, 0, 10))
    assert ids(a.read()) == ids(b.read()) == [*range(10), *range(100, 110)] and a.version() == 2
    with pytest.raises(sharding.ManifestConflict):
        a.commit(0, [])
    assert a.version() == 2


def test_a_writer_that_dies_blocks_nobody(spark, tmp_path, monkeypatch):
    s = sharding.ShardSet(spark, f"file://{tmp_path}/s")
    s.append(rows_of(spark, 0, 5))
    rows_of(spark, 50, 60).write.parquet(f"{s.root}/data/adead")  # died before its commit
    s._fs.create(s._fs_path(f"{s.root}/manifest/.half"), False).close()  # died while it wrote the manifest
    s.append(rows_of(spark, 5, 9))
    assert ids(s.read()) == list(range(9))
    s.vacuum()
    assert s._fs.exists(s._fs_path(f"{s.root}/data/adead"))  # may be about to be committed
    s.vacuum(0)
    assert not s._fs.exists(s._fs_path(f"{s.root}/data/adead")) and ids(s.read()) == list(range(9))


def test_a_tier_that_gains_nothing_does_not_block_the_next(spark, tmp_path):
    s = sharding.ShardSet(spark, f"file://{tmp_path}/s", target=60_000, small=1_000, shard_rows=10_000)
    r = random.Random(3)
    frame = lambda n, k: spark.createDataFrame([(k * 1000 + i, "".join(r.choice("abcdefghijklmnop") for _ in range(60))) for i in range(n)], "doc_id long, text string").coalesce(1)
    for k in range(5):
        s.append(frame(1, k))
    for k in range(5, 9):
        s.append(frame(120, k))
    small, large = s.runs(s.manifest())
    s.runs = lambda shards, runs=s.runs: [x for x in runs(shards)]
    want = ids(s.read())
    written = s._written
    blocked = {x.path for x in small}

    def no_gain(folder, arrival):  # the first tier's merge yields as many files as it had
        out = written(folder, arrival)
        return out * len(small) if arrival == small[0].arrival else out

    s._written = no_gain
    s.compact()
    left = s.manifest()
    assert blocked <= {x.path for x in left} and not {x.path for x in large} & {x.path for x in left} and ids(s.read()) == want


def test_empty_sets_and_clashing_names(spark, tmp_path):
    s = sharding.ShardSet(spark, f"file://{tmp_path}/s")
    assert s.read().collect() == [] and s.read(empty=rows_of(spark, 0, 1)).columns == ["doc_id", "text", "shard", "shard_bytes"]
    s.append(rows_of(spark, 0, 3).withColumn("_name", F.lit("mine")))
    assert {r._name for r in s.read().collect()} == {"mine"}
