"""Byte-level BPE with the tiktoken library and a local rank file.

The file is read on the driver and travels as a broadcast of fixed size, so executors need no copy of it.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import tiktoken

RANK_FILE = os.environ.get("GRAPHLOOM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pre-splitting pattern published with the 50,257-token byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 1 << 16  # bytes beyond which a text is encoded in parts
CALL = 1 << 20  # characters handed to the library in one call
#: Stands between the texts of one call; a text that holds it is encoded by a call of its own.
BETWEEN = "\uffff<|between|>\uffff"
#: White space as the pattern's \\s takes it, in runs that the pattern's look-ahead would need a deep stack for.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")

_OPEN: dict[int, Coder] = {}


def read_ranks(path: str = RANK_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Coder:
    """A rank file's encoding, for many texts in a call."""

    def __init__(self, table: dict[bytes, int]):
        self.n_vocab = max(table.values(), default=-1) + 1
        self._table, self._one = table, None
        self._many = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={BETWEEN: self.n_vocab})

    def whole(self, piece: str) -> np.ndarray:
        """The ids of a text that the pattern takes for one piece."""
        if self._one is None:
            self._one = tiktoken.Encoding("piece", pat_str="(?s).+", mergeable_ranks=self._table, special_tokens={})
        return self._one.encode_to_numpy(piece, disallowed_special=())

    def plain(self, text: str) -> np.ndarray:
        return self._many.encode_to_numpy(text, disallowed_special=())

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) by one call of the library."""
        got = self._many.encode_to_numpy(BETWEEN.join(texts), allowed_special={BETWEEN}, disallowed_special=())
        at = np.flatnonzero(got == self.n_vocab)
        return got[got != self.n_vocab], np.diff(at, prepend=-1, append=len(got)) - 1

    def decode_bytes(self, ids: list[int]) -> bytes:
        if ids and max(ids) >= self.n_vocab:
            raise KeyError(max(ids))
        return self._many.decode_bytes(ids)


def encoding(ranks: bytes) -> Coder:
    """The encoding of a rank file's bytes; one is kept per process."""
    key = hash(ranks)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())})
    return _OPEN[key]


def boundaries(raw: np.ndarray) -> np.ndarray:
    """Bytes before which a text may be cut without changing its tokens.

    They are single spaces between two characters that are not white space: every alternative of the pattern
    but the two for white space has a space as its first character only, so a piece always begins there.
    A neighbour outside ASCII counts if its bytes show that it is no white space: U+0085, U+00A0, U+1680,
    U+2000 to U+205F and U+3000 begin with C2, E1, E2 or E3, and letters of two bytes with C3 to DF.
    """
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(raw == 32)
    at = at[(at >= 2) & (at < len(raw) - 1)]
    after, before, lead = raw[at + 1], raw[at - 1], raw[at - 2]
    plain = lambda b: (b > 32) & (b < 127)
    after_ok = plain(after) | ((after >= 0xC3) & ~np.isin(after, (0xE1, 0xE2, 0xE3)))
    return at[after_ok & (plain(before) | ((before >= 0x80) & (lead >= 0xC3) & (lead <= 0xDF)))]


def parts(text: str, limit: int = LONG) -> list[tuple[str, bool]]:
    """The text cut at safe boundaries into parts of at most ``limit`` bytes where boundaries allow.

    The bool says that a part is one piece of the pattern, to be encoded without it: all of a long run of white
    space but its last character, which begins the next part, or the whole run where the text ends with it.
    """
    if len(text) * 4 <= limit:
        return [(text, False)]
    out, a = [], 0
    for run in _BLANKS.finditer(text):
        b = run.end() if run.end() == len(text) else run.end() - 1
        out += [(p, False) for p in _spaced(text[a : run.start()], limit)]
        out.append((text[run.start() : b], True))
        a = b
    return out + [(p, False) for p in _spaced(text[a:], limit)]


def _spaced(text: str, limit: int) -> list[str]:
    if not text:
        return []
    raw = text.encode()
    if len(raw) <= limit:
        return [text]
    cuts, out, a = boundaries(np.frombuffer(raw, np.uint8)), [], 0
    while len(raw) - a > limit:
        k = int(np.searchsorted(cuts, a + limit, side="right")) - 1
        if k < 0 or cuts[k] <= a:  # none near enough: the next one, however far
            k += 1
            if k >= len(cuts):
                break
        out.append(raw[a : cuts[k]].decode())
        a = int(cuts[k])
    return [*out, raw[a:].decode()]


def encode(coder: Coder, text: str, limit: int = LONG) -> np.ndarray:
    got = [coder.whole(p) if piece else coder.plain(p) for p, piece in parts(text, limit)]
    return got[0] if len(got) == 1 else np.concatenate(got)


def calls(coder: Coder, texts: list[str | None], size: int = CALL):
    """(ids, texts they are of, how many of each), a call at a time: about ``size`` characters in every call.

    Long texts are cut at safe boundaries, so a text can be in several calls; nulls are of no length.
    """
    batch, rows, held = [], [], 0
    for k, text in enumerate(texts):
        for p, piece in parts(text or ""):
            if piece or BETWEEN in p:
                if batch:
                    yield coder.joined(batch), rows
                    batch, rows, held = [], [], 0
                ids = coder.whole(p) if piece else coder.plain(p)
                yield (ids, np.array([len(ids)])), [k]
                continue
            batch.append(p)
            rows.append(k)
            held += len(p)
            if held >= size:
                yield coder.joined(batch), rows
                batch, rows, held = [], [], 0
    if batch:
        yield coder.joined(batch), rows


def encode_many(coder: Coder, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts, one after the other, how many of each)."""
    flat, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
    for (ids, sizes), rows in calls(coder, texts):
        flat.append(ids)
        np.add.at(counts, rows, sizes)
    return np.concatenate(flat), counts
