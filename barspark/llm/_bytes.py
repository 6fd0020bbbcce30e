"""Byte-level helpers shared by the text operators; they run inside Arrow tasks.

Texts are handled as UTF-8 bytes.  A *block* is a run of texts joined by a newline, small enough
(``BLOCK_BYTES`` unless one text is longer) that the working arrays of a task stay bounded.
Hashes are polynomial in a fixed odd base modulo 2**64 over a table of random 64-bit byte codes,
finished by a bit mixer; every hash of a substring comes from one cumulative sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
WINDOW = np.random.default_rng(20240611)
CODES = WINDOW.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = CODES.copy()
FOLDED[65:91] = CODES[97:123]
#: A-Z folded, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)

#: Words as runs of bytes that are not white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Words as runs of digits, letters and bytes beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def sums(buf: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Cumulative sums from which ``span_hash`` reads the hash of any span."""
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes[buf] * powers(BASE_INV, len(buf)), out=out[1:])
    return out


def span_hash(cum: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((cum[end] - cum[start]) * powers(BASE, len(cum))[start] + (end - start).astype(np.uint64))


def as_bytes(column) -> list[bytes]:
    """A string column as bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, starts): texts[first:last] joined by newlines, and where each begins."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < BLOCK_BYTES):
            size += len(texts[last]) + 1
            last += 1
        lengths = np.fromiter((len(t) + 1 for t in texts[first:last]), np.int64, last - first)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        yield first, last, np.frombuffer(b"\n".join(texts[first:last]), np.uint8), starts
        first = last


def words(buf: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = word_bytes[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_block(buf: np.ndarray, starts: np.ndarray, word_bytes: np.ndarray):
    """Hash of every word (A-Z folded), its text's number, its start and end in the block."""
    s, e = words(buf, word_bytes)
    h = span_hash(sums(buf, FOLDED), s, e)
    return h, np.searchsorted(starts, s, side="right") - 1, s, e


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
    return mix(out)
