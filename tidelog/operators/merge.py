"""Merge operators: fold the deltas of a key, in order of (seq, ord), on a base value.

Built-in operators lower to aggregates. ``fold`` runs any Python operator with ``applyInPandas``, for semantics that no
aggregate has.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ship import ship


class MergeOperator(Protocol):
    name: str

    def full_merge(self, key: bytes, base: bytes | None, deltas: Sequence[bytes]) -> bytes | None: ...

    def partial_merge(self, key: bytes, left: bytes, right: bytes) -> bytes | None: ...


def wrapped_sum(x: Column) -> Column:
    """Sum of longs modulo 2^64, as a signed long: what 64-bit addition that wraps gives. Decimals hold 10^19 terms."""
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    folded = F.pmod(F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)"), two64)
    return F.when(folded >= F.lit(str(1 << 63)).cast("decimal(38,0)"), folded - two64).otherwise(folded).cast("long")


def int64_add(deltas: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """deltas (cf, key, delta long): (cf, key, value), the wrapped sum with the base (cf, key, value long) if there is one.

    Null deltas and bases count as nothing. Partial sums are made before the shuffle, so hot keys are cheap.
    """
    rows = deltas.select("cf", "key", F.col("delta").alias("x"))
    if base is not None:
        rows = rows.unionByName(base.select("cf", "key", F.col("value").alias("x")))
    return rows.groupBy("cf", "key").agg(wrapped_sum(F.coalesce("x", F.lit(0))).alias("value"))


def string_append(deltas: DataFrame, sep: str = ",", base: DataFrame | None = None) -> DataFrame:
    """deltas (cf, key, seq, ord, delta): values in order, a separator between only where something stands before it."""
    rows = deltas.select("cf", "key", F.struct(F.lit(1).alias("late"), "seq", "ord", F.col("delta").alias("v")).alias("x"))
    if base is not None:
        rows = rows.unionByName(base.select("cf", "key", F.struct(F.lit(0).alias("late"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("ord"), F.col("value").alias("v")).alias("x")))
    rows = rows.where("x.v is not null").groupBy("cf", "key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = rows.select("cf", "key", F.col("xs.v").alias("vs")).withColumn("first", F.array_position(F.transform("vs", lambda v: v != ""), True))
    # what is empty before the first value that isn't leaves no trace
    return rows.select("cf", "key", F.when(F.col("first") == 0, "").otherwise(F.expr("array_join(slice(vs, cast(first as int), size(vs)), '%s')" % sep.replace("\\", "\\\\").replace("'", "\\'"))).alias("value"))


class Int64Add:
    """Little-endian 64-bit counters that wrap. A base that isn't 8 bytes counts as 0, such deltas as nothing."""

    name = "Int64Add"

    def full_merge(self, key, base, deltas):
        values = [x for x in ([base] if base is not None else []) + list(deltas) if len(x) == 8]
        total = sum(struct.unpack("<q", x)[0] for x in values) & ((1 << 64) - 1)
        return struct.pack("<Q", total)

    def partial_merge(self, key, left, right):
        return self.full_merge(key, None, [left, right]) if len(left) == len(right) == 8 else None


class StringAppend:
    name = "StringAppend"

    def __init__(self, sep: bytes = b","):
        self.sep = sep

    def full_merge(self, key, base, deltas):
        out = base or b""
        for x in deltas:
            out = out + self.sep + x if out else bytes(x)
        return out

    def partial_merge(self, key, left, right):
        return left + self.sep + right


class MergeState:
    """Deltas of one key, pushed in order, and what they resolve to."""

    def __init__(self, key: bytes, base: bytes | None, op: MergeOperator):
        self.key, self.base, self.op, self.deltas = key, base, op, []

    def push(self, delta: bytes) -> None:
        self.deltas.append(delta)

    def resolve(self) -> bytes | None:
        return self.op.full_merge(self.key, self.base, self.deltas) if self.deltas else self.base


def fold(deltas: DataFrame, op: MergeOperator, base: DataFrame | None = None) -> DataFrame:
    """deltas (cf, key binary, seq, ord, delta binary), base (cf, key, value): (cf, key, value) by any operator."""
    ship(deltas.sparkSession)
    rows = deltas.select("cf", "key", "seq", "ord", F.col("delta").alias("x"), F.lit(False).alias("base"))
    if base is not None:
        rows = rows.unionByName(base.select("cf", "key", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("ord"), F.col("value").alias("x"), F.lit(True).alias("base")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["base"]].sort_values(["seq", "ord"])
        start = pdf[pdf["base"]]["x"]
        state = MergeState(bytes(pdf["key"].iloc[0]), bytes(start.iloc[0]) if len(start) and start.iloc[0] is not None else None, op)
        for x in own["x"]:
            if x is not None:
                state.push(bytes(x))
        return pd.DataFrame({"cf": [pdf["cf"].iloc[0]], "key": [pdf["key"].iloc[0]], "value": [state.resolve()]})

    return rows.groupBy("cf", "key").applyInPandas(one, "cf string, key binary, value binary")
