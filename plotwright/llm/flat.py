"""Whole batches of texts as one byte array: words, their hashes and counts by document without a Python loop."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from plotwright.llm.packed import mix

BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


@lru_cache
def _numbers() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)


class Flat:
    """Texts (none null) as bytes, each followed by one separator byte."""

    def __init__(self, texts: pa.Array, separator: bytes = b" "):
        raw = [x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
        self.bytes = np.frombuffer(separator.join([*raw, b""]), np.uint8)
        self.lens = np.array(list(map(len, raw)), np.int64)
        self.starts = np.cumsum(self.lens + len(separator)) - self.lens - len(separator)
        self.ends = self.starts + self.lens

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Marked bytes in each text."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the marked runs; separators must be unmarked."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
        return edge[::2], edge[1::2]

    def strings(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> pa.Array:
        """The strings between."""
        b = LOWER[self.bytes] if lower else self.bytes
        size = ends - starts
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        body = b[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)]
        return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])

    def codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A number for each of the strings between; two are equal if and only if the strings are."""
        return self.strings(starts, ends).dictionary_encode().indices.to_numpy()

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the strings between, for bins: equal for equal strings, but long strings can be made that differ and agree."""
        b = LOWER[self.bytes] if lower else self.bytes
        power, inverse = _powers(1 << max(21, len(b).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_numbers()[b] * power[: len(b)])])
        return mix((sums[ends] - sums[starts]) * inverse[starts])

