"""Array views of Arrow text columns: words, lines and n-grams as numpy vectors.

Everything here is a per-batch helper for code that Spark has already
partitioned. Texts stay UTF-8 bytes, so nothing is decoded and no Python object
is made per word; work goes through chunks of a bounded number of bytes (a text
longer than that is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PRIME = np.uint64((1 << 31) - 1)
_PRIME_BASE = 1_220_703_125
_PRIME_PIECE = 1 << 24  # bytes of a piece up to which its sum of products stays below 2**64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _prime_powers(base: int, size: int) -> np.ndarray:
    out, n = np.ones(size, np.uint64), 1
    while n < size:
        step = np.uint64(pow(base, n, int(_PRIME)))
        out[n : 2 * n] = out[: min(n, size - n)] * step % _PRIME
        n *= 2
    return out


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of a base and of its inverse, modulo 2**64 and modulo a prime, grown on demand."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = [*out, _prime_powers(_PRIME_BASE, size), _prime_powers(pow(_PRIME_BASE, -1, int(_PRIME)), size)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Chunk:
    """Consecutive texts: ``data[starts[i]:ends[i]]`` is the text of row ``first + i``."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of ``flags`` (one per byte) in each text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.ends] - total[self.starts]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``limit`` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if n == 0:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(i, raw[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i])
        i = j


@dataclass
class Pieces:
    """Words or lines of a chunk: byte spans, the index of their text, and a 64-bit hash each."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # pieces of text i: bounds[i] to bounds[i + 1]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each piece: a polynomial modulo 2**64 next to one modulo a prime, as the former alone
    is equal for some pairs of words by their pattern."""
    up, down, prime_up, prime_down = _power_tables(len(data) + 1)
    own = data.astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(own * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    np.cumsum(own * prime_up[: len(data)], out=total[1:])
    other = (total[ends] - total[starts]) % _PRIME * prime_down[starts] % _PRIME
    size = ends - starts
    other[size > _PRIME_PIECE] = 0
    return mix(h + mix(other) + size.astype(np.uint64))


def words(chunk: Chunk, lower: bool, bare: bool = False) -> Pieces:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``lower`` folds A-Z (only) before hashing.

    ``bare`` leaves ASCII punctuation at the ends of a word out of its hash and
    span, unless there is nothing else in it.
    """
    data = _LOWER[chunk.data] if lower else chunk.data
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[chunk.starts] = True
    edge[chunk.ends] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    bounds = np.searchsorted(starts, np.append(chunk.starts, len(data)))
    text = np.repeat(np.arange(len(chunk)), np.diff(bounds))
    if bare and len(starts):
        inner = np.append(np.flatnonzero(solid & ~_PUNCTUATION[data]), len(data))
        left = inner[np.searchsorted(inner[:-1], starts)]
        right = inner[np.searchsorted(inner[:-1], ends) - 1] + 1
        some = left < ends
        starts, ends = np.where(some, left, starts), np.where(some, right, ends)
    return Pieces(starts, ends, text, _hashed(data, starts, ends), bounds)


def lines(chunk: Chunk) -> Pieces:
    """Lines between ``\\n``; every text has at least one, perhaps empty."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.starts, breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.ends, breaks]), kind="stable")
    inside = np.searchsorted(breaks, np.append(chunk.starts, len(chunk.data)))
    bounds = inside + np.arange(len(chunk) + 1)
    text = np.repeat(np.arange(len(chunk)), np.diff(bounds))
    return Pieces(starts, ends, text, _hashed(chunk.data, starts, ends), bounds)


def ngrams(pieces: Pieces, offsets: list[int] | range) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``i + offset`` for each offset, for all i whose whole span lies in one text.

    Gives the positions i and the hashes. Offsets with gaps are spaced seeds.
    """
    span = max(offsets) + 1
    n = len(pieces.hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(pieces.text[:n] == pieces.text[span - 1 :])
    h = np.zeros(n, np.uint64)
    for k, o in enumerate(offsets):
        h = h * np.uint64(0xD6E8FEB86659FD93) + pieces.hashes[o : o + n] + np.uint64(k)
    return at, mix(h[at])
