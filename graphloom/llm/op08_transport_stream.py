"""Media columns: MPEG transport streams taken apart into their elementary packets.

For each value of a binary column: the program association and map tables are parsed (sections with a wrong
CRC are left out), continuity counters are checked for every PID, elementary packets are put together again
from the payloads of their transport packets, and each comes back with its timestamps and whether it is a
random-access point.  Sync is found at the first offset with ``SURE`` sync bytes SIZE apart, or as many as the
rest of the value has room for, and sought again wherever it is lost: bytes that were lost or inserted cost only
the packets they fall in.  A single packet without its sync byte between others that have it is skipped.  What is
skipped shows as a gap in its PID.  A loss of sync also counts as a gap in the unit of the packet before it, which
may hold bytes put in, and in every unit of no declared length whose PID has no packet after it.

Per value all transport packets are handled at once on numpy arrays; nothing is shuffled.

Defined results.  Null, empty and unreadable values give no rows.  A packet repeated once (same counter and
bytes) is dropped, as the standard allows.  A gap in a PID's counter makes the elementary packet in which it
falls incomplete, and so does a declared length that isn't reached.  Streams in no program map are not returned.
A program map counts from its place on, until a later one says otherwise; before the first, that one counts, and a
stream that later maps leave out keeps its last entry.  Tables sent ahead of their time (current_next_indicator 0) are
passed over.  Scrambled packets can't be read: they are left out and count as gaps, and a unit whose first packet is
scrambled is not returned.  A very long value is held whole in one task.  Rows that repeat are read each.  Empty table: empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.ts_media import crc32, media_of_pages

SIZE, SURE = 188, 4
COLUMNS = "program int, pid int, stream_type int, ordinal int, stream_id int, pts long, dts long, random_access boolean, gaps int, complete boolean, payload binary"


def aligned(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packets x SIZE that begin with a sync byte, how many of them stand before each loss of sync, which may hold bytes put in)."""
    whole = len(raw) // SIZE
    if whole and (raw[::SIZE] == 0x47).all():  # also the packet cut short at the end, if there is one
        return raw[: whole * SIZE].reshape(whole, SIZE), np.zeros(0, np.int64), np.zeros(whole, bool)
    last = len(raw) - SIZE  # where the last whole packet can begin
    sync = np.flatnonzero(raw[: max(0, last + 1)] == 0x47)
    is_sync = np.zeros(len(raw) + SURE * SIZE, bool)
    is_sync[sync] = True
    followed = np.ones(len(sync), bool)
    for k in range(1, SURE):
        followed &= is_sync[sync + k * SIZE] | (sync + k * SIZE > last)
    sure = sync[followed]
    starts: list[int] = []
    breaks, doubtful, at = [], [], 0
    while at <= last:
        column = is_sync[at : last + 1 : SIZE]
        off = np.flatnonzero(~column)
        good = int(off[0]) if len(off) else len(column)
        starts += range(at, at + good * SIZE, SIZE)
        at += good * SIZE
        if at > last and (at == len(raw) or raw[at] == 0x47):  # a packet cut short
            break
        if starts:
            breaks.append(len(starts))
            if len(column) > good + 1 and column[good + 1 : good + SURE].all():
                at += SIZE  # only this packet's sync byte is wrong
                continue
        # bytes may be missing in the packet before, so a new one may begin inside it; a lone one must end the value
        found = sure[np.searchsorted(sure, starts[-1] + 1 if starts else 0) :]
        found = found[is_sync[found + SIZE] | (found == last)] if starts else found
        if starts and len(found) and found[0] < at:
            starts.pop()
            breaks[-1] -= 1
        elif starts:
            doubtful.append(len(starts) - 1)
        if not len(found):
            break
        at = int(found[0])
    begin, doubt = np.array(starts, np.int64), np.zeros(len(starts), bool)
    doubt[doubtful] = True
    return raw[begin[:, None] + np.arange(SIZE)].reshape(-1, SIZE), np.array(breaks, np.int64), doubt


def sections(payloads: list[tuple[int, bool, bytes]]) -> list[tuple[int, bytes]]:
    """(place, section): whole sections with a right CRC, from a table PID's (place, unit start, payload)s."""
    out, held, at = [], b"", 0
    for place, start, data in payloads:
        if start:
            skip = data[0] + 1 if data else 1
            held += data[1:skip]
            out += [(at, x) for x in _cut(held)]
            held, at = data[skip:], place
        elif held:
            held += data
    return out + [(at, x) for x in _cut(held)]


def _cut(data: bytes) -> list[bytes]:
    out = []
    while len(data) >= 3 and data[0] != 0xFF:
        n = 3 + ((data[1] & 15) << 8 | data[2])
        if len(data) < n:
            break
        if n >= 12 and crc32(data[:n]) == 0:
            out.append(data[:n])
        data = data[n:]
    return out


def programs(payloads_of) -> dict[int, list[tuple[int, int, int]]]:
    """Elementary PID -> (place from which it counts, program, stream type), from the program tables in order."""
    maps: dict[tuple[int, int], None] = {}
    for _, pat in sections(payloads_of(0)):
        for k in range(8, len(pat) - 4, 4):
            program, pid = pat[k] << 8 | pat[k + 1], (pat[k + 2] & 31) << 8 | pat[k + 3]
            if pat[0] == 0 and pat[5] & 1 and program:
                maps[program, pid] = None
    found: dict[int, list[tuple[int, int, int]]] = {}
    for program, pid in maps:
        before = b""
        for place, pmt in sections(payloads_of(pid)):
            if pmt == before or pmt[0] != 2 or (pmt[3] << 8 | pmt[4]) != program or not pmt[5] & 1:
                continue
            before = pmt
            at = 12 + ((pmt[10] & 15) << 8 | pmt[11])
            while at + 5 <= len(pmt) - 4:
                found.setdefault((pmt[at + 1] & 31) << 8 | pmt[at + 2], []).append((place, program, pmt[at]))
                at += 5 + ((pmt[at + 3] & 15) << 8 | pmt[at + 4])
    return {pid: sorted(entries, key=lambda e: e[0]) for pid, entries in found.items()}


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def take_apart(data: bytes) -> list[tuple]:
    """One tuple of COLUMNS for each elementary packet, by program, PID and place in the stream."""
    p, breaks, doubt = aligned(np.frombuffer(data, np.uint8))
    sound = p[:, 1] & 0x80 == 0  # without transport error
    breaks = np.concatenate([[0], np.cumsum(sound)])[breaks]
    p, doubt = p[sound], doubt[sound]
    if not len(p):
        return []
    pid = (p[:, 1] & 31).astype(np.int32) << 8 | p[:, 2]
    has_adapt, has_data = p[:, 3] & 0x20 != 0, p[:, 3] & 0x10 != 0
    adapt = np.where(has_adapt, p[:, 4].astype(np.int64) + 1, 0)
    flags = np.where(has_adapt & (adapt > 1), p[:, 5], 0)
    begin = np.minimum(4 + adapt, SIZE)
    start, count = p[:, 1] & 0x40 != 0, (p[:, 3] & 15).astype(np.int64)

    def rows_of(k: int) -> np.ndarray:
        """The PID's packets that carry data, without repeats."""
        at = np.flatnonzero((pid == k) & has_data)
        if len(at) < 2:
            return at
        again = (count[at[1:]] == count[at[:-1]]) & (p[at[1:]] == p[at[:-1]]).all(axis=1)
        return at[np.append(True, ~again)]

    def payloads_of(k: int) -> list[tuple[int, bool, bytes]]:
        return [(int(r), bool(start[r]), p[r, begin[r] :].tobytes()) for r in rows_of(k)]

    scrambled = p[:, 3] & 0xC0 != 0
    out = []
    for k, entries in programs(payloads_of).items():
        at = rows_of(k)
        gap = np.zeros(len(at), np.int64)
        gap[1:] = ((count[at[1:]] - count[at[:-1]]) & 15) != 1
        gap[flags[at] & 0x80 != 0] = 0  # an announced discontinuity
        heads = np.flatnonzero(start[at])
        keep = (np.arange(SIZE) >= begin[at][:, None]) & ~scrambled[at][:, None]
        flat, ends = p[at][keep], np.cumsum(keep.sum(axis=1))
        for n, (a, b) in enumerate(zip(heads, np.append(heads[1:], len(at)))):
            unit = flat[ends[a - 1] if a else 0 : ends[b - 1]].tobytes()
            # a gap before the first transport packet of a unit belongs to the unit before it
            lost = int(gap[a + 1 : b].sum()) + int(b < len(at) and gap[b])
            lost += int(doubt[at[a:b]].sum()) + int(scrambled[at[a:b]].sum())
            if scrambled[at[a]]:
                continue
            _, program, kind = next((e for e in reversed(entries) if e[0] <= at[a]), entries[0])
            if len(unit) < 6 or unit[:3] != b"\0\0\1":
                continue
            declared = unit[4] << 8 | unit[5]
            if b == len(at) and not declared and not lost:  # no counter or length shows what a later loss of sync took
                lost = int((breaks > at[b - 1]).sum())
            body, pts, dts = unit[6:], None, None
            if len(unit) >= 9 and unit[6] & 0xC0 == 0x80:
                body = unit[9 + unit[8] :]
                if unit[7] & 0x80 and len(unit) >= 14:
                    pts = _time(unit[9:14])
                    dts = _time(unit[14:19]) if unit[7] & 0x40 and len(unit) >= 19 else pts
            whole = lost == 0 and (declared == 0 or len(unit) >= declared + 6)
            if declared and len(unit) > declared + 6:
                body = body[: len(body) - (len(unit) - declared - 6)]
            out.append((program, k, kind, n, unit[3], pts, dts, bool(flags[at[a]] & 0x40), lost, whole, body))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def elementary(media: DataFrame, id_column: str = "media_id", column: str = "media") -> DataFrame:
    """(media_id, program, pid, stream_type, ordinal, stream_id, pts, dts, random_access, gaps, complete, payload)."""
    kinds = f"media_id {media.schema[id_column].dataType.simpleString()}, {COLUMNS}"

    def run(batches):
        types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in COLUMNS.split(", ")])
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows, of = [], []
                for k, data in enumerate(part.column(1)):
                    got = take_apart(data.as_buffer().to_pybytes()) if data.is_valid else []
                    rows += got
                    of += [k] * len(got)
                columns = list(zip(*rows)) if rows else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, schema))], names=["media_id", *schema.names])

    return media.select(id_column, column).mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elementary(media_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
