"""Vectorised byte-level text primitives shared by the llm operators.

Everything works on whole UTF-8 texts straight from Arrow buffers.  A *chunk* is a run of
documents whose texts lie side by side in one byte buffer; chunks are cut by bytes, never
inside a document, so the working set of a worker stays near ``CHUNK_BYTES`` (or the
longest single document) whatever the size of the Arrow batch.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased.  A word
hash is a polynomial hash over a random byte table followed by a 64-bit finaliser, and an
n-gram hash mixes n word hashes with position-dependent odd multipliers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values from a seed; the same in every process."""
    return mix64((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _P)


_TABLE = splitmix(256, 11) | _U(1)
_NGRAM = splitmix(64, 23) | _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n (cached, grown by doubling)."""
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK_BYTES, 1 << (n - 1).bit_length())
        for k, base in enumerate((_P, _PINV)):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            if len(_powers) > k:
                _powers[k] = p
            else:
                _powers.append(p)
    return _powers[0], _powers[1]


class Chunk:
    """Documents ``first..last`` of an Arrow string column: bytes, document offsets."""

    __slots__ = ("first", "last", "data", "offsets")

    def __init__(self, first: int, last: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.data, self.offsets = first, last, data, offsets

    def __len__(self) -> int:
        return self.last - self.first

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and per document the index of its first word
        (one entry more than documents)."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        solid = ~_SPACE[self.data]
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = solid[:-1]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[cut] = False  # a document's first byte never continues a word
        starts = np.flatnonzero(solid & ~before)
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = solid[1:]
        after[cut - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, _U)
        up, down = powers(len(self.data) + 1)
        table = _TABLE[_FOLD] if fold else _TABLE
        acc = np.empty(len(self.data) + 1, dtype=_U)
        acc[0] = 0
        np.cumsum(table[self.data] * up[: len(self.data)], out=acc[1:])
        return mix64((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(_U))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string column into chunks; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, dat = column.buffers()
    offs = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield Chunk(i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def ngram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences inside documents, and per document the index of its
    first one (one entry more than documents)."""
    count = np.maximum(np.diff(first) - (n - 1), 0)
    at = np.concatenate(([0], np.cumsum(count)))
    total = len(words) - n + 1
    if total <= 0 or at[-1] == 0:
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    acc = words[:total] * _NGRAM[0]
    for j in range(1, n):
        acc += words[j : j + total] * _NGRAM[j]
    # positions whose n words lie in one document
    keep = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    return mix64(acc[keep]), at


def shingles(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Like ngram_hashes; a document of 1..n-1 words has its whole sequence as one."""
    full, at = ngram_hashes(words, first, n)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    if not len(short):
        return full, at
    one = np.zeros(len(short), _U)
    for k, d in enumerate(short):
        w = words[first[d] : first[d + 1]]
        one[k] = mix64(np.array([(w * _NGRAM[: len(w)]).sum(dtype=_U) + _U(len(w))], dtype=_U))[0]
    return np.insert(full, at[short], one), at + np.concatenate(([0], np.cumsum((size > 0) & (size < n))))


def multipliers(n: int, seed: int = 77) -> np.ndarray:
    """Odd 32-bit multipliers, one per hash function of a MinHash family."""
    return (splitmix(n, seed) >> _U(32)).astype(np.uint32) | np.uint32(1)


def minima(hashes32: np.ndarray, factors: np.ndarray, block: int = 256) -> np.ndarray:
    """Minimum under each hash function ``x -> (x * factor) mod 2**32`` of one set."""
    out = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint32)
    row = factors[None, :]
    for i in range(0, len(hashes32), block):
        np.minimum(out, (hashes32[i : i + block, None] * row).min(axis=0), out=out)
    return out


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow list column whose rows are consecutive runs of ``values``."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
