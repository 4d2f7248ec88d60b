"""Vectorised tokenisation of many texts at once with numpy, for the operators that run in Python workers."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

U64 = np.uint64
#: An odd multiplier for polynomial hashes modulo 2^64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(1)
def char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; is it a letter or digit."""
    letter = np.zeros(0x110000, bool)
    digit = np.zeros(0x110000, bool)
    for c in range(0x33480):
        s = chr(c)
        letter[c] = s.isalpha()
        digit[c] = s.isdigit()
    return letter, letter | digit


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, BASE, U64)), np.cumprod(np.full(n, BASE_INV, U64))


@dataclass
class Tokens:
    """Words of a list of texts: code points, word bounds in them, word hashes, and for each text its range of words."""

    codes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    def of(self, k: int) -> slice:
        return slice(self.bounds[k], self.bounds[k + 1])


def chunks(texts: list[str], most: int = 300_000):
    """Ranges of texts of about ``most`` code points together, so that memory follows the chunk and not the batch."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, k
            at, held = k, 0
        held += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def tokenize(texts: list[str], digits: bool = False) -> Tokens:
    """Lower-cased words (runs of letters, with ``digits`` also of digits) of all texts."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, alnum = char_tables()
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (alnum if digits else letter)[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = 1 << max(19, int(len(codes) + 1).bit_length())
    power, inverse = _powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(len(codes) + 1, U64)
        np.cumsum(mix(codes.astype(U64) + U64(1)) * power[: len(codes)], out=total[1:])
        hashes = mix((total[end] - total[start]) * inverse[start])
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Tokens(codes, start, end, hashes, np.searchsorted(start, offsets))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; a text of fewer words, but not none, is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        out = np.full(n, U64(k))
        for i in range(k):
            out = out * U64(BASE) + words[i : i + n]
    return mix(out)
