"""Byte codecs, checksums and hashes as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def le_i64(v: Column) -> Column:
    """Little-endian signed 64-bit integer of 8 bytes; null for other lengths."""
    hexed = F.array_join(F.reverse(F.regexp_extract_all(F.hex(v), F.lit(".."), F.lit(0))), "")
    return F.when(F.octet_length(v) == 8, F.conv(hexed, 16, -10).cast("long"))


def be_u64(v: Column) -> Column:
    """Big-endian unsigned 64-bit integer of the first 8 bytes, as a decimal."""
    return F.conv(F.substring(F.hex(v), 1, 16), 16, 10).cast("decimal(20,0)")


def record_crc(*cols: str) -> Column:
    """CRC32 (IEEE) of a record's fields; a field that is null differs from one that is empty."""
    return F.crc32(F.to_json(F.struct(*cols)).cast("binary"))


def metric_bucket(ns: Column) -> Column:
    """floor(log2 ns), 0 for 0, by the length of the binary form, which is exact."""
    return F.when(ns == 0, 0).otherwise(F.length(F.bin(ns)) - 1)


def _rolling(keys: pd.Series, start: int, step) -> np.ndarray:
    """Hash many byte strings together, byte position by byte position."""
    data = [bytes(k) if not isinstance(k, str) else k.encode() for k in keys]
    n = np.array([len(d) for d in data])
    h = np.full(len(data), start, np.uint64)
    if len(data) and n.max():
        grid = np.zeros((len(data), int(n.max())), np.uint8)
        grid[np.arange(grid.shape[1]) < n[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        with np.errstate(over="ignore"):
            for j in range(grid.shape[1]):
                h = np.where(j < n, step(h, grid[:, j].astype(np.uint64)), h)
    return h


def fnv1a_hash(keys: pd.Series) -> np.ndarray:
    """64-bit FNV-1a."""
    return _rolling(keys, 0xCBF29CE484222325, lambda h, b: (h ^ b) * np.uint64(0x100000001B3))


def djb2_hash(keys: pd.Series) -> np.ndarray:
    """64-bit djb2: h * 33 + byte from 5381; 0 becomes 1, as the hash is a stride."""
    h = _rolling(keys, 5381, lambda h, b: h * np.uint64(33) + b)
    return np.where(h == 0, np.uint64(1), h)


def fnv1a(key: Column) -> Column:
    """FNV-1a of a string or binary column, as a signed long. 64-bit products that wrap are an error in SQL, so this is an Arrow UDF."""
    return F.pandas_udf(lambda keys: pd.Series(fnv1a_hash(keys).view(np.int64)), "long", F.PandasUDFType.SCALAR)(key)


def djb2(key: Column) -> Column:
    return F.pandas_udf(lambda keys: pd.Series(djb2_hash(keys).view(np.int64)), "long", F.PandasUDFType.SCALAR)(key)
