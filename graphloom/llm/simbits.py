"""128-bit SimHash fingerprints of whole texts, computed on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from graphloom.llm import textbytes as tb

BITS = 128
_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x 2 uint64, distinct words per row).

    The features are a text's distinct lower-cased words, weighted by their length in bytes up to 12: long
    words are rare ones, so this stands in for inverse document frequency without a pass over the corpus.
    A text without words gets the fingerprint 0 and a count of 0.
    """
    out, counts = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    for s in tb.text_slices(texts):
        w = tb.words(s)
        if not len(w.hash):
            continue
        key = tb.row_keys(w.hash, w.row)
        order = np.argsort(key)
        at = order[tb.firsts(key[order])]
        row, n = w.row[at], len(s.offsets) - 1
        total = row_bits(w.hash[at], np.minimum(w.end[at] - w.start[at], 12).astype(np.float64), row, n)
        have = np.bincount(row, minlength=n)
        bits = np.packbits(total > 0, axis=1).view(np.uint64)
        bits[have == 0] = 0
        out[s.first : s.first + n] = bits
        counts[s.first : s.first + n] = have
    return out, counts


def row_bits(h: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Per row and bit, the weight of features with that bit less the weight of those without.

    Weights are first summed by the value of each of a hash's bytes, and those sums then spread over the
    byte's bits by one small matrix product.  Sums of small integers, so exact.
    """
    both = np.stack([h, tb.mix(h ^ np.uint64(0x5851F42D4C957F2D))], axis=1).view(np.uint8).reshape(len(h), 16)
    at, out = row * 256, np.empty((n, 16, 8))
    for k in range(16):
        out[:, k] = np.bincount(at + both[:, k], weight, n * 256).reshape(n, 256) @ _BITS_OF
    return 2 * out.reshape(n, BITS) - np.bincount(row, weight, n)[:, None]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)
