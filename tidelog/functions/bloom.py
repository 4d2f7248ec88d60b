"""An explicit Bloom filter over keys, built in Spark and probed by an Arrow UDF.

Parquet's own Bloom filters (see sources.store) serve scans; this object is for passing a filter around.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from .codec import djb2_hash, fnv1a_hash

#: Bits a key for about 1 % false positives, hash functions, least bits.
BITS_PER_KEY, HASHES, LEAST_BITS = 9.585, 7, 64


class BloomFilter:
    def __init__(self, n: int):
        self.bits = max(LEAST_BITS, int(n * BITS_PER_KEY))
        self.words = np.zeros((self.bits + 63) // 64, np.uint64)
        self.k = HASHES

    def places(self, keys) -> np.ndarray:
        keys = pd.Series(list(keys), dtype=object)
        with np.errstate(over="ignore"):
            h = fnv1a_hash(keys)[:, None] + np.arange(self.k, dtype=np.uint64) * djb2_hash(keys)[:, None]
        return h % np.uint64(self.bits)

    def insert(self, *keys) -> None:
        at = self.places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))

    def may_contain(self, keys) -> np.ndarray:
        at = self.places(keys)
        return ((self.words[(at >> np.uint64(6)).astype(int)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QI", self.bits, self.k) + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BloomFilter:
        out = cls(0)
        out.bits, out.k = struct.unpack_from("<QI", data)
        out.words = np.frombuffer(data, np.uint64, offset=12).copy()
        return out

    @classmethod
    def build(cls, keys: DataFrame, n: int | None = None) -> BloomFilter:
        """From column ``key``: bits are set by a bit_or over words, after partial aggregation; only the words reach the driver."""
        ship(keys.sparkSession)
        out = cls(keys.count() if n is None else n)

        def place(batches):
            for pdf in batches:
                at = np.unique(out.places(pdf["key"]).ravel())
                yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

        words = keys.select("key").mapInPandas(place, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
        for r in words:
            out.words[r.word] = np.uint64(r.bits & ((1 << 64) - 1))
        return out

    def probe(self, key: Column) -> Column:
        spark = SparkSession.active()
        ship(spark)
        known = spark.sparkContext.broadcast(self)  # once an executor, in place of once a task

        @F.pandas_udf("boolean")
        def test(keys: pd.Series) -> pd.Series:
            return pd.Series(known.value.may_contain(keys))

        return test(key)
