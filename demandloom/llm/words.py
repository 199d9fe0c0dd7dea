"""Words, lines and shingles of whole Arrow batches as numpy arrays, without a Python loop per word.

Texts are UTF-8 bytes. A word is a run of bytes that are not separators; every separator is ASCII, so
a run never splits a code point. A hash is a polynomial over the bytes modulo 2**64, taken from one
prefix sum over the batch and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer single text is a piece of its own.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEED_STEP = np.uint64(0xD1B54A32D192ED03)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the contamination rule: all of ASCII but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
NEWLINE = np.zeros(256, dtype=bool)
NEWLINE[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Tables(dict):
    """Kept within one process; an empty one travels with functions."""

    def __reduce__(self):
        return _Tables, ()


_tables = _Tables()


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first `n` powers of `base` modulo 2**64, kept for the next batch."""
    known = _tables.get(int(base))
    if known is None or len(known) < n:
        grown = np.full((n | 0xFFFF) + 1, base, dtype=np.uint64)
        grown[0] = 1
        known = _tables[int(base)] = np.multiply.accumulate(grown)
    return known[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values; another seed gives another order."""
    with np.errstate(over="ignore"):
        x = x + _SEED_STEP * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that their texts hold about `limit` bytes; no text is cut."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def runs(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-separators, and the first run of each text (with the total last)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begins = offsets[:-1][offsets[:-1] < n]
    edge = np.zeros(n + 1, dtype=bool)
    edge[begins] = True
    edge[n] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:n]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(head)
    ends = np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes of every span; spans may overlap or be empty."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n + 1)[:n], out=total[1:])
        # Dividing by the power at the start makes equal bytes give equal values anywhere.
        value = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _MIX[0], seed)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` words in a row (also across texts; the caller cuts them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * _BASE + words[k : k + n]
        return mix(total, width)


#: Modulus and base of a second polynomial; sums of 2**33 residues stay below 2**64.
_PRIME = (1 << 31) - 1
_SECRET = 1_402_946_357


def _residue_powers(base: int, n: int) -> np.ndarray:
    """The first `n` powers of `base` modulo the prime, kept for the next batch."""
    known = _tables.get(("residue", base))
    if known is None or len(known) < n:
        grown = np.ones(1, np.uint64)
        step = base
        while len(grown) < max(n, 1 << 16):
            grown = np.concatenate([grown, grown * np.uint64(step) % np.uint64(_PRIME)])
            step = step * step % _PRIME
        known = _tables[("residue", base)] = grown
    return known[:n]


def firm_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Like `span_hashes`, with a polynomial modulo a prime beside the one modulo 2**64.

    The latter alone gives equal values to some long strings of two letters, whatever its base is.
    """
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    prime = np.uint64(_PRIME)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _residue_powers(_SECRET, n) % prime
    np.cumsum(terms, out=total[1:])
    value = (total[ends] - total[starts]) % prime * _residue_powers(pow(_SECRET, -1, _PRIME), n + 1)[starts] % prime
    return mix(span_hashes(data, starts, ends) ^ (value << np.uint64(32)), seed)


def firm_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` words in a row, each word mixed in by its place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix(total ^ words[k : k + n], k)
    return total


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
