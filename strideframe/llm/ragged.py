"""Words of many texts at once, as numpy arrays over one byte buffer.

A batch of texts is an Arrow string array; its bytes are handled without a Python object
for each word. Word hashes are 64 bits wide: sums of a random number per byte times powers
of an odd constant, mixed. Memory is bounded by cutting batches into chunks of bytes; only
a single longer text makes a longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
U = np.uint64

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES), base & (2**64 - 1), dtype=np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0]


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``most`` bytes (one row at least): (first, last, bytes, offsets)."""
    raw, off = buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


@dataclass
class Words:
    """Words of some rows: where each starts and ends, its hash, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray  # n rows + 1 offsets into the words


def words(raw: np.ndarray, off: np.ndarray, separator: np.ndarray = SPACES) -> Words:
    """Maximal runs of bytes that aren't separators, within each row; A-Z count as a-z."""
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separator[raw]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = off[(off > 0) & (off < n)]
    first[cuts] = inside[1:-1][cuts]
    last[cuts - 1] = inside[1:-1][cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[LOWER[raw]] * _power(_BASE, n), out=sums[1:])
    return Words(start, end, mix((sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start]), np.searchsorted(start, off))


def shingles(w: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words, and each row's offsets into them.

    A row of fewer words, but not none, has one shingle: all its words.
    """
    count = np.diff(w.row)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    row = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(w.row[:-1] - row[:-1], n) + np.arange(row[-1])
    size = np.repeat(np.minimum(count, width), n)
    total, padded = size.astype(np.uint64), np.concatenate((w.hash, np.zeros(width, np.uint64)))
    for j in range(width):
        total = mix(total * U(0xD6E8FEB86659FD93) + np.where(size > j, padded[at + j], U(0)))
    return total, row


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
