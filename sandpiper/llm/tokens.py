"""Vectorised helpers on many texts at once: words, word hashes, window hashes.

Texts come in as bytes (UTF-8). A word is a run of bytes other than ASCII white space
(0x20, 0x09-0x0D), which is the same as ``[^\\x20\\x09-\\x0D]+`` on the characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the polynomial hashes; any odd 64-bit numbers do.
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93
BUCKET_BASE = 0xA0761D6478BD642F
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (an invertible finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


@dataclass
class Words:
    """The words of several texts. Word k of text d is at first[d] + k."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        n = len(self.buf)
        sums = np.zeros(n + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * powers(BYTE_BASE, n), out=sums[1:])
        inverse = powers(pow(BYTE_BASE, -1, 1 << 64), n)
        h = sums[self.ends] - sums[self.starts]
        return mix(h * inverse[self.starts] + (self.ends - self.starts).astype(U)) if len(h) else h


def split_words(texts: list[bytes], keep: np.ndarray | None = None) -> Words:
    """Words of every text. keep: 256 booleans, the bytes words are made of."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if keep is None:
        inside = (buf != 32) & ((buf < 9) | (buf > 13))
    else:
        inside = keep[buf]
        at = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        inside[at] = False
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offsets[1:])
    return Words(buf, starts, ends, np.searchsorted(starts, offsets))


def windows(h: np.ndarray, k: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive hashes, by doubling."""
    if len(h) < k:
        return np.zeros(0, U)
    if k == 1:
        return h
    half = k // 2
    a = windows(h, half, base)
    both = a[: len(a) - half] * U(pow(base, half, 1 << 64)) + a[half:]
    return both if k % 2 == 0 else both[:-1] * U(base) + h[k - 1 :]


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """For every word: whether k words of its own text start there (for all words but the last k - 1)."""
    n = int(first[-1])
    ok = np.ones(max(0, n - k + 1), bool)
    for end in first[1:]:
        ok[max(0, int(end) - k + 1) : int(end)] = False
    return ok


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


#: Not every C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def relieve() -> None:
    """Give back what Arrow and numpy have let go of: a Python worker lives on from stage to stage, and so does what it keeps."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def parcels(batches, most_rows: int = 4096, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with a bounded number of bytes (one row at least). Numpy takes some 50 times as many."""
    for batch in batches:
        at = 0
        per_row = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(most_rows, most_bytes // per_row))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step
    relieve()
