import numpy as np

from graphloom.llm import op08_transport_stream as op
from graphloom.llm import ts_media as ts
from tests.llm.helpers import rows

PICTURE, SOUND = bytes(range(256)) * 50, b"https://example.org/sound"


def slow(data):
    """A reader of well-formed streams, one transport packet at a time."""
    pids, open_, out, last, gaps = {}, {}, [], {}, {}
    def close(pid):
        if pid in open_:
            u, ra, g = open_.pop(pid)
            two = u[7] & 0x40
            out.append((pid, op._time(u[9:14]), op._time(u[14:19]) if two else op._time(u[9:14]), ra, g, u[9 + u[8] :]))
    for a in range(0, len(data) - 187, 188):
        p = data[a : a + 188]
        pid = (p[1] & 31) << 8 | p[2]
        at, ra = 4, False
        if p[3] & 0x20:
            ra = p[4] > 0 and bool(p[5] & 0x40)
            at = 5 + p[4]
        if pid in (ts.VIDEO, ts.SOUND):
            n = p[3] & 15
            gap = pid in last and n != (last[pid] + 1) & 15
            last[pid] = n
            if gap and pid in open_:
                open_[pid][2] += 1
            if p[1] & 0x40:
                close(pid)
                open_[pid] = [p[at:], ra, 0]
            elif pid in open_:
                open_[pid][0] += p[at:]
    for pid in list(open_):
        close(pid)
    return sorted(out, key=lambda r: (r[0], r[1]))


def parsed(data):
    return [(r[1], r[5], r[6], r[7], r[8], r[10]) for r in op.take_apart(data)]


def test_whole_stream():
    data = ts.stream(PICTURE, SOUND)
    got = op.take_apart(data)
    assert b"".join(r[10] for r in got if r[1] == ts.VIDEO) == PICTURE
    assert {r[10] for r in got if r[1] == ts.SOUND} == {SOUND}
    assert {(r[0], r[1], r[2]) for r in got} == {(1, ts.VIDEO, 0x1B), (1, ts.SOUND, 0x0F)}
    video = [r for r in got if r[1] == ts.VIDEO]
    assert [r[6] for r in video] == [90_000 + k * ts.STEP for k in range(len(video))] and all(r[5] - r[6] == ts.STEP for r in video)
    assert [r[7] for r in video] == [k % ts.GROUP == 0 for k in range(len(video))]
    assert all(r[9] for r in got) and parsed(data) == slow(data)


def test_lost_packets_are_seen_and_other_packets_unhurt():
    data = ts.stream(PICTURE, SOUND)
    p = [data[a : a + 188] for a in range(0, len(data), 188)]
    video = [k for k, x in enumerate(p) if (x[1] & 31) << 8 | x[2] == ts.VIDEO and not x[1] & 0x40]
    lost = video[7]
    got = op.take_apart(b"".join(p[:lost] + p[lost + 1 :]))
    broken = [r for r in got if not r[9]]
    assert len(broken) == 1 and broken[0][8] == 1
    whole = {(r[1], r[3]): r for r in op.take_apart(data)}
    assert all(r == whole[r[1], r[3]] for r in got if r[9])
    assert parsed(b"".join(p[:lost] + p[lost + 1 :])) == slow(b"".join(p[:lost] + p[lost + 1 :]))


def test_repeats_offsets_errors_and_rubbish():
    data = ts.stream(PICTURE, SOUND)
    p = [data[a : a + 188] for a in range(0, len(data), 188)]
    want = op.take_apart(data)
    assert op.take_apart(b"".join(x for y in p for x in (y, y))) == want  # every packet sent twice
    assert op.take_apart(b"\x00\x11\x47" + data) == want
    assert op.take_apart(data + data[:100]) == want
    bad = bytes([p[0][0], p[0][1], p[0][2], p[0][3]]) + b"\0\xff" + p[0][6:]
    assert op.take_apart(b"".join([bad, *p[1:]])) == want  # the first PAT is broken, a later one isn't
    assert op.take_apart(b"") == op.take_apart(b"G" * 187) == op.take_apart(bytes(1000)) == []
    noise = np.random.default_rng(0).integers(0, 256, 188 * 40, dtype=np.uint8)
    noise[::188] = 0x47
    assert isinstance(op.take_apart(noise.tobytes()), list)


def test_a_table_that_spans_packets():
    body = b"".join(bytes([0x1B]) + (0xE000 | 0x200 + k).to_bytes(2, "big") + b"\xf0\0" for k in range(60))
    section = ts._section(2, 1, (0xE000 | 0x200).to_bytes(2, "big") + b"\xf0\0" + body)
    c = {}
    data = b"".join(ts.packets(0, ts.TABLES[0][1] + b"\xff" * (184 - len(ts.TABLES[0][1])), c) + ts.packets(ts.PMT, section + b"\xff" * (-len(section) % 184), c) + ts.packets(0x21F, ts.pes(0xE0, b"x" * 500, 5, 5), c))
    assert [(r[1], r[10]) for r in op.take_apart(data)] == [(0x21F, b"x" * 500)]


def test_table(spark):
    one = ts.stream(PICTURE, SOUND)
    long = ts.stream(PICTURE * 40, SOUND)
    table = spark.createDataFrame([(1, one, "c", 1), (1, one, "c", 1), (None, one, "c", 1), (2, None, "c", 1), (3, b"", "c", 1), (4, b"rubbish", "c", 1), (5, long, "c", 1)], "media_id long, media binary, payload string, pid int")
    got = op.elementary(table)
    n = {r["media_id"]: r["count"] for r in got.groupBy("media_id").count().collect()}
    each = len(op.take_apart(one))
    assert n == {1: 2 * each, None: each, 5: len(op.take_apart(long))}
    assert op.elementary(table.limit(0)).count() == 0


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>" * 900, "x"), (2, None, "", "x"), (3, "u", None, "x"), (None, "u", "<b>", "x")], "page_id long, url string, html string, media string")
    got = op.elementary(ts.media_of_pages(pages)).where(f"pid = {ts.VIDEO}").orderBy("media_id", "ordinal").collect()
    assert b"".join(bytes(r["payload"]) for r in got if r["media_id"] == 1).decode() == "<p>é</p>" * 900
    assert {r["media_id"] for r in got} == {1, None}
    assert rows(ts.media_of_pages(pages).where("media_id = 3")) == [(3, None)]


def test_a_byte_lost_or_inserted_in_the_middle_costs_only_its_packet():
    data = ts.stream(PICTURE, SOUND)
    whole = {(r[1], r[5]): r for r in op.take_apart(data)}
    n = len(data) // 188
    video = [k for k in range(n) if (data[188 * k + 1] & 31) << 8 | data[188 * k + 2] == ts.VIDEO and not data[188 * k + 1] & 0x40]
    for k in (video[3], video[len(video) // 2], video[-2]):
        at = 188 * k + 100
        for cut in (data[:at] + data[at + 1 :], data[:at] + b"\x11" + data[at:], data[:at] + data[at + 80 :], data[:at] + bytes(500) + data[at:]):
            got = op.take_apart(cut)
            assert {(r[1], r[5]) for r in got} == set(whole)
            broken = [r for r in got if not r[9]]
            assert len(broken) == 1 and broken[0][1] == ts.VIDEO and broken[0][8] >= 1
            assert all(r[4:] == whole[r[1], r[5]][4:] for r in got if r[9])


def test_a_break_after_which_nothing_is_in_sync_makes_the_open_unit_incomplete():
    c = {}
    body = b"".join(ts.packets(0, ts.TABLES[0][1] + b"\xff" * (184 - len(ts.TABLES[0][1])), c) + [x for pid, t in ts.TABLES[1:] for x in ts.packets(pid, t + b"\xff" * (-len(t) % 184), c)])
    unit = bytearray(ts.pes(0xE0, b"x" * 184 * 12, 5, 5))
    unit[4:6] = b"\0\0"  # no declared length
    video = ts.packets(ts.VIDEO, bytes(unit), c)
    assert [r[9] for r in op.take_apart(body + b"".join(video))] == [True]
    got = op.take_apart(body + b"".join(video[:6]) + bytes(188 * 4))
    assert [(r[8], r[9]) for r in got] == [(1, False)]


def _map(streams, version, current=1):
    body = (0xE000 | ts.VIDEO).to_bytes(2, "big") + b"\xf0\0" + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for kind, pid in streams)
    head = bytes([2, 0xB0, len(body) + 9, 0, ts.PROGRAM, 0xC0 | version << 1 | current, 0, 0]) + body
    section = b"\0" + head + ts.crc32(head).to_bytes(4, "big")
    return section + b"\xff" * (184 - len(section))


def test_a_later_version_of_the_map_counts_from_its_place():
    c = {}
    pat = ts.packets(0, ts.TABLES[0][1] + b"\xff" * (184 - len(ts.TABLES[0][1])), c)
    one = lambda pid, k: ts.packets(pid, ts.pes(0xE0, bytes([k]) * 400, k, k), c)
    parts = [pat, one(0x100, 0), ts.packets(ts.PMT, _map([(0x1B, 0x100)], 0), c), one(0x100, 1), ts.packets(ts.PMT, _map([(0x24, 0x100), (0x0F, 0x102)], 1, 0), c), one(0x100, 2), ts.packets(ts.PMT, _map([(0x24, 0x100), (0x0F, 0x102)], 1), c), one(0x100, 3), one(0x102, 4), one(0x103, 5)]
    got = op.take_apart(b"".join(x for y in parts for x in y))
    assert [(r[1], r[2], r[5]) for r in got] == [(0x100, 0x1B, 0), (0x100, 0x1B, 1), (0x100, 0x1B, 2), (0x100, 0x24, 3), (0x102, 0x0F, 4)]


def test_scrambled_packets_are_gaps():
    data = ts.stream(PICTURE, SOUND)
    p = [bytearray(data[a : a + 188]) for a in range(0, len(data), 188)]
    whole = {(r[1], r[3]): r for r in op.take_apart(data)}
    video = [k for k, x in enumerate(p) if (x[1] & 31) << 8 | x[2] == ts.VIDEO]
    middle = next(k for k in video[5:] if not p[k][1] & 0x40)
    p[middle][3] |= 0x80
    got = op.take_apart(b"".join(p))
    assert len(got) == len(whole) and [r[8:10] for r in got if r != whole[r[1], r[3]]] == [(1, False)]
    p[middle][3] &= 0x3F
    head = next(k for k in video[20:] if p[k][1] & 0x40)
    p[head][3] |= 0xC0
    got = op.take_apart(b"".join(p))
    assert len(got) == len(whole) - 1 and all(r == whole[r[1], r[3]] for r in got)
