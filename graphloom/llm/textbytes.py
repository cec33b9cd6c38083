"""Vectorised tokenising and hashing of Arrow string columns.

All functions look at the raw UTF-8 buffer of an Arrow array, a slice of about
``SLICE_BYTES`` at a time so that the temporaries stay in cache, and never loop
over rows or words in Python.  A text longer than a slice is a slice of its own,
and its words are hashed a block of bytes at a time.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
SLICE_ROWS = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLOCK = 1 << 18  # bytes hashed at a time
_SUMS = np.zeros(BLOCK + 1, np.uint64)  # kept, as fresh pages cost more than the sums; the first stays 0

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(base: np.uint64) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


with np.errstate(over="ignore"):
    _POW, _INV = _powers(_BASE), _powers(_BASE_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, off, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Slice:
    first: int  # row of the array at which it begins
    data: np.ndarray  # uint8
    offsets: np.ndarray  # rows + 1


def slices(data: np.ndarray, offsets: np.ndarray, target: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of about ``target`` bytes; every row is in exactly one."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + target, side="right")) - 1
        b = min(max(b, a + 1), n, a + SLICE_ROWS)
        yield Slice(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def text_slices(texts: pa.Array, lower: bool = True, target: int = SLICE_BYTES) -> Iterator[Slice]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.utf8_lower(texts)
    yield from slices(*buffers(texts), target=target)


@dataclass
class Words:
    start: np.ndarray  # byte of the slice
    end: np.ndarray
    row: np.ndarray  # row in the slice
    hash: np.ndarray  # uint64
    first: np.ndarray  # rows + 1: first word of each row


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of non-empty byte spans in ascending order, the same wherever the bytes stand."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = (end - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    with np.errstate(over="ignore"):
        if len(data) <= BLOCK:
            total = _totals(data)
            return mix((total[end] - total[start]) * _INV[start] + size)
        h, before = np.zeros(len(start), np.uint64), np.uint64(0)
        for a in range(0, len(data), BLOCK):
            b = min(a + BLOCK, len(data))
            power, total = np.uint64(pow(int(_BASE), a, 1 << 64)), _totals(data[a:b])
            ends, starts = np.searchsorted(end, [a + 1, b + 1]), np.searchsorted(start, [a, b])
            h[slice(*ends)] += before + power * total[end[slice(*ends)] - a]
            h[slice(*starts)] -= before + power * total[start[slice(*starts)] - a]
            before = before + power * total[b - a]
        for a in range(0, len(data), BLOCK):
            starts = slice(*np.searchsorted(start, [a, a + BLOCK]))
            h[starts] *= np.uint64(pow(int(_BASE_INV), a, 1 << 64)) * _INV[start[starts] - a]
        return mix(h + size)


def _totals(data: np.ndarray) -> np.ndarray:
    """The hash's sum over the bytes before each place, of a block."""
    terms = _SUMS[1 : len(data) + 1]
    np.take(_TABLE, data, out=terms, mode="clip")
    np.multiply(terms, _POW[: len(data)], out=terms)
    np.cumsum(terms, out=terms)
    return _SUMS[: len(data) + 1]


def _wide(data: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """Marks signs outside ASCII as no part of words; the places before and after each character of scripts without spaces.

    Signs: U+0080 to U+00BF but for the letters ª, µ and º, U+2000 to U+206F, U+3000 to U+303F, U+FE30 to U+FE6F and
    U+FF00 to U+FF0F, with the other full-width signs up to U+FF65.  Scripts: Thai, Lao, Burmese, Khmer, Kana,
    Chinese characters and their extensions.
    """
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return lead
    first = data[lead]
    second = data[np.minimum(lead + 1, len(data) - 1)]
    third = data[np.minimum(lead + 2, len(data) - 1)]
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    full = (first == 0xEF) & (((second == 0xBC) & ((third < 0x90) | ((third > 0x99) & (third < 0xA1)) | (third > 0xBA))) | ((second == 0xBD) & ((third < 0x81) | ((third > 0x9A) & (third < 0xA6)))))
    sign = (first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA)) | (first == 0xE2) & (second <= 0x81) | (first == 0xE3) & (second == 0x80) | (first == 0xEF) & ((second == 0xB8) & (third >= 0xB0) | (second == 0xB9)) | full
    for k in range(4):
        at = lead[sign & (size > k)] + k
        is_word[at[at < len(data)] + 1] = 0
    alone = (first == 0xE0) & np.isin(second, (0xB8, 0xB9, 0xBA, 0xBB)) | (first == 0xE1) & np.isin(second, (0x80, 0x81, 0x82, 0x9E, 0x9F)) | (first >= 0xE3) & (first <= 0xE9) & ~sign | (first == 0xF0) & (second >= 0xA0) & (second <= 0xB3)
    return np.concatenate([lead[alone], lead[alone] + size[alone]])


def words(s: Slice, hashes: bool = True) -> Words:
    """Maximal runs of letters and digits, row by row; of scripts without spaces, each character.

    Letters are those of ASCII and all beyond it but for the signs that _wide() lists.
    """
    n = len(s.data)
    is_word = np.zeros(n + 2, np.int8)
    np.take(WORD_BYTE, s.data, out=is_word[1:-1].view(bool), mode="clip")
    inner = np.concatenate([s.offsets[1:-1], _wide(s.data, is_word)])
    flips = np.diff(is_word)
    start, end = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):  # a row's end also ends a word
        cut = np.unique(inner[(is_word[inner] == 1) & (is_word[inner + 1] == 1)])
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    first = np.searchsorted(start, s.offsets)
    row = np.repeat(np.arange(len(s.offsets) - 1), np.diff(first))
    return Words(start, end, row, span_hash(s.data, start, end) if hashes else np.zeros(0, np.uint64), first)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of n words inside one row."""
    k = len(w.hash) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = w.hash[:k].copy()
        for j in range(1, n):
            h = h * _BASE + w.hash[j : j + k]
    at = np.flatnonzero(w.row[:k] == w.row[n - 1 :])
    return mix(h[at]), at


def row_keys(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One key of (row, hash): 20 bits of the row and 44 of the hash, so that a sort is one of plain integers.

    Rows of a slice are at most 2**20; of a million distinct words in a row, 0.03 pairs are expected to share
    their 44 bits.
    """
    return row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)


def firsts(key: np.ndarray) -> np.ndarray:
    """Indices at which a sorted array's value changes, 0 included."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


class Keys:
    """Membership and position of 64-bit hashes in a fixed set, with a bitmap before the search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes.astype(np.uint64))
        self.bits = int(min(26, max(16, np.ceil(np.log2(max(1, len(self.sorted)))) + 5)))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self.sorted >> np.uint64(64 - self.bits)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices into h that are members, their positions in the sorted set)."""
        at = np.flatnonzero(self.map[h >> np.uint64(64 - self.bits)])
        if not len(at) or not len(self.sorted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[pos] == h[at]
        return at[hit], pos[hit]
