"""Log shipping and streaming state.

A follower applies the primary's commits in the order of their numbers, with their original seqs. The number of the last one applied is
part of each of its own commits, so whatever it loses - its checkpoint, or a run between a write and its commit - each
commit is applied once. A stream over the primary's commit files only tells when there is something to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.resolve import with_ord
from ..schema import LOG, RANGE_DEL
from ..ship import ship
from ..sources.store import Store


class FollowerBehind(Exception):
    """The primary has deleted data that the follower hasn't applied; it must start from a copy."""


def tail(spark: SparkSession, store_path: str) -> DataFrame:
    """The log of a store as a stream. Files appear only when their job commits."""
    return spark.readStream.schema(f"{LOG}, crc long").parquet(f"{store_path.rstrip('/')}/log").select("cf", "key", "seq", "ord", "op", "value", "expires_at")


def applied(replica: Store, primary: str) -> int:
    """The number of the last commit of the primary that the replica has; -1 for none."""
    return max((c["from"] for c in replica._commits if c.get("of") == primary), default=-1)


def catch_up(spark: SparkSession, primary: str, replica: Store) -> int:
    """Apply the commits that the replica lacks; how many. Consecutive writes of one kind are one job and one commit."""
    source = Store(spark, primary, ())
    replica._refresh()
    done = applied(replica, primary)
    todo = [(n, c) for n, c in enumerate(source._commits) if n > done]
    k = 0
    while k < len(todo):
        kind = todo[k][1]["kind"]
        e = k + 1
        while kind in ("log", "range_del") and e < len(todo) and todo[e][1]["kind"] == kind:
            e += 1
        run, mark = [c for _, c in todo[k:e]], {"of": primary, "from": todo[e - 1][0], "seq": todo[e - 1][1]["seq"]}
        if kind == "create_cf":
            replica.create_cf(run[0]["cf"])
            replica._commit({"kind": "mark", **mark})
        elif kind in ("log", "range_del"):
            folders = [c["folder"] for c in run]
            missing = [f for f in folders if not source._fs.exists(source._path(f"{source.path}/{f}"))]
            if missing:
                raise FollowerBehind(f"{missing} of {primary}")
            rows = source._read(folders) if kind == "log" else spark.read.schema(RANGE_DEL).parquet(*[f"{source.path}/{f}" for f in folders])
            replica._commit({"kind": kind, "folder": replica._write(rows, kind), **mark})
        k = e
    return len(todo)


def replicate(spark: SparkSession, primary: str, replica: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the replica at the primary's state. All kinds of mutation, range deletes too, keep their seqs and expiry."""
    commits = spark.readStream.option("wholetext", "true").option("pathGlobFilter", "*.json").text(f"{primary.rstrip('/')}/commits")
    out = commits.writeStream.foreachBatch(lambda _, __: catch_up(spark, primary, replica) and None).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def latest_stream(log: DataFrame) -> DataFrame:
    """Streaming newest version per key (update or complete mode): a native streaming aggregate, its state one row a key."""
    newest = with_ord(log).groupBy("cf", "key").agg(F.max_by(F.struct("seq", "op", "value", "expires_at"), F.struct("seq", "ord")).alias("v"))
    return newest.select("cf", "key", "v.seq", "v.op", "v.value", "v.expires_at")


def expiring_stream(log: DataFrame, at: str, delay: str = "0 seconds") -> DataFrame:
    """Streaming state with expiry (update mode): (cf, key, seq, value, state) whenever a key becomes 'live', 'deleted' or 'expired'.

    ``at`` is the column of event times. A key's state is its newest version; it leaves the state when the watermark passes its expiry, and
    a tombstone when the watermark passes it, so the state holds live keys only. A version older than one seen is ignored.
    """
    import pandas as pd

    ship(log.sparkSession)
    rows = with_ord(log).withWatermark(at, delay)
    out = "cf string, key string, seq long, value string, state string"

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            seq, _, op, value, _ = state.get
            state.remove()
            if op != "del":
                yield pd.DataFrame([(*key, seq, value, "expired")], columns=["cf", "key", "seq", "value", "state"])
            return
        top = state.get if state.exists else None
        before = top
        for pdf in frames:
            for r in pdf.itertuples():
                if top is None or (r.seq, r.ord) > top[:2]:
                    top = (int(r.seq), int(r.ord), r.op, None if r.op == "del" else r.value, int(r.expires_at))
        if top == before:
            return
        mark = state.getCurrentWatermarkMs()
        _, _, op, value, expires = top
        dead = op != "del" and expires and expires <= mark
        if dead:
            if state.exists:
                state.remove()
        else:
            state.update(top)
            if op == "del":
                state.setTimeoutTimestamp(mark + 1)
            elif expires:
                state.setTimeoutTimestamp(expires)
        yield pd.DataFrame([(*key, top[0], value, "deleted" if op == "del" else "expired" if dead else "live")], columns=["cf", "key", "seq", "value", "state"])

    return rows.groupBy("cf", "key").applyInPandasWithState(step, out, "seq long, ord int, op string, value string, expires_at long", "update", GroupStateTimeout.EventTimeTimeout)
