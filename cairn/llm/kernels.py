"""Vectorised byte-level text kernels shared by the Python-side operators.

Every function works on a *chunk*: the UTF-8 bytes of some whole texts laid end
to end, plus the offsets at which they begin.  Word classes in this package are
defined on code points below 0x80 (everything above is a word character), so
working on bytes gives exactly the words that a code-point scan gives.

All hashes are 64-bit and depend on the content only, so a task that is run
again on another executor produces the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are processed at a time (a longer single text is one chunk).
CHUNK_BYTES = 1 << 18

U64 = np.uint64
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def _byte_table(separators) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM_BYTES = _byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NONSPACE_BYTES = _byte_table([0x20, *range(0x09, 0x0E)])

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place on a uint64 array; returns it."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = table
    return table[:n]


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    if column.null_count:  # the range of a null may hold stray bytes
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
        buffers = column.buffers()
        off = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    pa.default_memory_pool().release_unused()  # else a worker keeps the most that any batch took


class Words:
    """Words of a chunk: byte ranges, the text each belongs to, and 64-bit hashes."""

    __slots__ = ("starts", "ends", "doc", "first", "data", "_prefix", "hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True, hashed: bool = True):
        n_docs = len(offsets) - 1
        if lower:
            data = LOWER_BYTES[data]
        self.data = data
        inside = word_bytes[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
            after[-1] = False
            after[:-1] = inside[1:]
            self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
            self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        #: index of each text's first word, and one past the last word of all
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.first))
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def room(self) -> np.ndarray:
        """For each word, how many words its text still has from there on."""
        return self.first[1:][self.doc] - np.arange(len(self))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by prefix sums of a polynomial."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    prefix = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE_CODES[data] * _power_table(_BASE, len(data)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power_table(_BASE_INV, len(data) + 1)[starts]
    h += (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(h)


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words starts[i] .. ends[i]-1, for runs of any length."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    n = len(hashes)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(hashes * _power_table(_BASE, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power_table(_BASE_INV, n + 1)[starts]
    h += (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(h)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; the last k-1 entries are meaningless."""
    n = len(hashes)
    out = np.full(n, (k * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    for j in range(k):
        m = n - j
        if m <= 0:
            break
        out[:m] *= U64(0xE7037ED1A0B428DB)
        out[:m] += hashes[j:]
    return mix(out)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over values[i:i+width] by doubling; tails take what there is."""
    out = values.copy()
    span = 1
    while span < width:
        step = min(span, width - span)
        if step < len(out):
            out[:-step] = op(out[:-step], out[step:])
        span += step
    return out


def winnow(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """Positions of the minimal gram of every window of ``width`` grams.

    Ties select every minimum, so any two equal runs of ``width`` valid grams
    select the same positions inside the run.
    """
    g = np.where(valid, grams, _FULL)
    if width <= 1:
        return np.flatnonzero(valid)
    low = sliding(g, width, np.minimum)  # of the window that begins at i
    best = low.copy()  # largest window minimum over the windows that hold i
    span = 1
    while span < width:
        step = min(span, width - span)
        if step < len(best):
            best[step:] = np.maximum(best[step:], best[:-step])
        span += step
    return np.flatnonzero(valid & (best == g))


def spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i, first[i] .. first[i]+counts[i]-1, laid end to end, with the i of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return first[owner] + np.arange(len(owner)) - begin[owner], owner


def union_lengths(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean array of length n that is true inside any of the ranges."""
    depth = np.bincount(starts, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxhash64_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for a bigint column, as uint64."""
    v = values.astype(np.int64).view(U64)
    h = np.full(len(v), (seed + int(_P5) + 8) & 0xFFFFFFFFFFFFFFFF, dtype=U64)
    h ^= _rotl(v * _P2, 31) * _P1
    h = _rotl(h, 27) * _P1 + _P4
    h ^= h >> U64(33)
    h *= _P2
    h ^= h >> U64(29)
    h *= _P3
    h ^= h >> U64(32)
    return h
