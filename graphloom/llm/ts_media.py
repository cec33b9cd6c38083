"""A media column made from web pages, as no table holds one: each page becomes an MPEG transport stream.

A page's bytes are the video stream, ``FRAME`` bytes to a picture, every ``GROUP``-th picture a random-access
point; its URL is the sound, one packet to eight pictures.  The tables come first and again with every
random-access point.  Deterministic, and plain Python: it stands in for a camera, not for an operator.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, GROUP, STEP = 2048, 4, 3003  # STEP: ticks of 90 kHz between pictures
PMT, VIDEO, SOUND, PROGRAM = 0x1000, 0x100, 0x101, 1


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32(data: bytes) -> int:
    """The CRC of program tables; 0 over a section that ends with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return b"\0" + head + crc32(head).to_bytes(4, "big")


TABLES = (
    (0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT).to_bytes(2, "big"))),
    (PMT, _section(2, PROGRAM, (0xE000 | VIDEO).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for kind, pid in ((0x1B, VIDEO), (0x0F, SOUND))))),
)


def stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


def pes(stream: int, payload: bytes, pts: int, dts: int | None = None) -> bytes:
    times = stamp(2, pts) if dts is None else stamp(3, pts) + stamp(1, dts)
    size = len(payload) + 3 + len(times)
    return b"\0\0\1" + bytes([stream]) + (size if size < 65536 and stream != 0xE0 else 0).to_bytes(2, "big") + bytes([0x80, 0x80 if dts is None else 0xC0, len(times)]) + times + payload


def packets(pid: int, data: bytes, counter: dict[int, int], random_access: bool = False) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        first = at == 0
        adapt = bytes([1, 0x40]) if first and random_access else b""
        room = 184 - len(adapt)
        part = data[at : at + room]
        at += len(part)
        if len(part) < room:  # stuffing
            spare = room - len(part)
            adapt = bytes([adapt[0] + spare, adapt[1]]) + b"\xff" * spare if adapt else (b"\0" if spare == 1 else bytes([spare - 1, 0]) + b"\xff" * (spare - 2))
        n = counter[pid] = (counter.get(pid, -1) + 1) & 15
        out.append(bytes([0x47, first << 6 | pid >> 8, pid & 255, (0x30 if adapt else 0x10) | n]) + adapt + part)
    return out


def stream(picture: bytes, sound: bytes) -> bytes:
    out: list[bytes] = []
    counter: dict[int, int] = {}
    for k, a in enumerate(range(0, len(picture), FRAME)):
        if k % GROUP == 0:
            for pid, section in TABLES:
                out += packets(pid, section + b"\xff" * (184 - len(section)), counter)
        t = 90_000 + k * STEP
        out += packets(VIDEO, pes(0xE0, picture[a : a + FRAME], t + STEP, t), counter, k % GROUP == 0)
        if k % 8 == 0 and sound:
            out += packets(SOUND, pes(0xC0, sound, t), counter)
    return b"".join(out)


def media_of_pages(pages: DataFrame) -> DataFrame:
    """(media_id, media): a transport stream of each page; null where html is null."""
    def run(batches):
        for batch in batches:
            media = [None if h is None else stream(h.encode(), (u or "").encode()) for u, h in zip(batch["url"].to_pylist(), batch["html"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(media, pa.binary())], names=["media_id", "media"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "media_id long, media binary")
