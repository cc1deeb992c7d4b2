import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import transport_stream as M
from strandloom.llm.queries import media_digests


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(0, 40))
def test_round_trip(tail, blocks):
    data = bytes(range(192)) * blocks + tail
    media = M.write_stream(data)
    assert len(media) % M.PACKET == 0
    found = M.parse_stream(media)
    assert found["data"] == data
    assert (found["bad_packets"], found["continuity_errors"], found["bad_tables"], found["bad_pes"]) == (0, 0, 0, 0)
    assert [u["pts"] for u in found["units"]] == [k * M.TICKS for k in range(len(found["units"]))]
    assert [u["random_access"] for u in found["units"]] == [k % M.KEY_EVERY == 0 for k in range(len(found["units"]))]
    assert found["programs"] == [{"program": 1, "pid": M.MAP_PID}]


def test_known_checksum():
    assert M.section_crc(b"123456789") == 0x0376E6E7  # published check value of CRC-32/MPEG-2


def test_losses_are_counted():
    media = M.write_stream(bytes(M.UNIT * 4))
    packets = [media[k : k + M.PACKET] for k in range(0, len(media), M.PACKET)]
    lost = M.parse_stream(b"".join(packets[:4] + packets[5:]))
    assert lost["continuity_errors"] == 1 and lost["bad_pes"] == 1 and len(lost["units"]) == 3
    twice = M.parse_stream(b"".join(packets[:4] + packets[3:4] + packets[4:]))
    assert twice["continuity_errors"] == 0 and len(twice["units"]) == 4
    broken = bytearray(media)
    broken[M.PACKET + 20] ^= 1
    assert M.parse_stream(bytes(broken))["bad_tables"] == 1
    assert M.parse_stream(b"junk")["bad_packets"] == 1 and M.parse_stream(b"")["units"] == []


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=188 * 4))
def test_any_bytes_parse(data):
    M.parse_stream(data)
    M.parse_stream(M.TABLES + data)


def test_digests(spark):
    texts = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 5000), (None, "x"), (6, "x")]
    frame = spark.createDataFrame([(k, t, "m") for k, t in texts], "doc_id long, text string, media string")
    got = {(r.doc_id, r.n_bytes): r for r in media_digests(frame).collect()}
    for key, text in texts:
        raw = (text or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        row = got[key, len(raw)]
        assert row.payload_bytes == len(want) and row.tail_crc32 == zlib.crc32(want[-16:])
        media = M.write_stream(want)
        assert row.payload_sha256 == hashlib.sha256(want).hexdigest() and row.payload_bytes == len(M.parse_stream(media)["data"])
        assert (row.media_bytes, row.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        n = -(-len(want) // M.UNIT)
        assert row.feature == f"units={n},random_access={-(-n // M.KEY_EVERY)},last_pts={(n - 1) * M.TICKS},continuity_errors=0"
    assert got[None, 1].feature == got[6, 1].feature and got[None, 1].media_sha256 == got[6, 1].media_sha256
    assert media_digests(frame.limit(0)).count() == 0


def packet(pid, counter, payload, first=False, adaptation=b""):
    """A packet put together bit by bit from the format's description, not by the writer under test."""
    room = 184 - len(payload)
    if adaptation or room:
        body = adaptation or b"\x00"
        field = bytes([room - 1]) + body.ljust(room - 1, b"\xff") if room > 1 else b"\x00"
        return struct.pack(">BHB", 0x47, (0x4000 if first else 0) | pid, 0x30 | counter) + field + payload
    return struct.pack(">BHB", 0x47, (0x4000 if first else 0) | pid, 0x10 | counter) + payload


def section(table, number, body):
    data = bytes([table]) + struct.pack(">HHBBB", 0xB000 | (len(body) + 9), number, 0xC3, 0, 0) + body
    crc = 0xFFFFFFFF
    for bit in (byte >> k & 1 for byte in data for k in range(7, -1, -1)):
        crc = ((crc << 1) & 0xFFFFFFFF) ^ (0x04C11DB7 if (crc >> 31) ^ bit else 0)
    return data + struct.pack(">I", crc)


def stamp(mark, ticks):
    bits = f"{mark:04b}" + f"{ticks >> 30:03b}1" + f"{ticks >> 15 & 0x7FFF:015b}1" + f"{ticks & 0x7FFF:015b}1"
    return int(bits, 2).to_bytes(5, "big")


def test_a_stream_of_another_writer(spark):
    """Video with PTS, DTS and PCR and PES packets of open length, audio beside it, a map over two packets, null packets."""
    descriptors = b"\x0a\x04eng\x00" * 30
    pat = section(0, 9, struct.pack(">HHHH", 0, 0xE010, 7, 0xE020))
    pmt = section(2, 7, struct.pack(">HH", 0xE100, 0xF000) + struct.pack(">BHH", 0x1B, 0xE100, 0xF000 | len(descriptors)) + descriptors + struct.pack(">BHH", 0x0F, 0xE101, 0xF000))
    clock = (5000 << 15 | 0x3F << 9 | 17).to_bytes(6, "big")
    video = [b"\x00\x00\x01\xe0\x00\x00\x80\xc0\x0a" + stamp(3, (1 << 32) + 9000) + stamp(1, (1 << 32) + 5400) + b"V" * 120, b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + stamp(2, 12600) + b"W" * 50]
    audio = b"\x00\x00\x01\xc0" + struct.pack(">H", 8 + 30) + b"\x80\x80\x05" + stamp(2, 777) + b"A" * 30
    head = b"\x00" + pmt
    stream = [
        packet(0, 3, b"\x00" + pat, True), packet(0x20, 0, head[:184], True), packet(0x20, 1, head[184:]), packet(0x1FFF, 0, b"x" * 184),
        packet(0x100, 15, video[0][:100], True, b"\x50" + clock), packet(0x101, 4, audio, True), packet(0x100, 0, video[0][100:]), packet(0x100, 1, video[1], True),
    ]
    assert all(len(p) == M.PACKET for p in stream)
    found = M.parse_stream(b"".join(stream))
    assert found["programs"] == [{"program": 7, "pid": 0x20}] and [(s["pid"], s["type"]) for s in found["streams"]] == [(0x100, 0x1B), (0x101, 0x0F)]
    assert found["data"] == b"V" * 120 + b"W" * 50 + b"A" * 30 and found["continuity_errors"] == found["bad_pes"] == found["bad_tables"] == 0
    rows = spark.createDataFrame([(1, b"".join(stream)), (2, None)], "id long, media binary")
    got = {tuple(r)[2:] for r in M.unit_index(M.parse_column(rows), "id").collect()}
    assert got == {(0x100, (1 << 32) + 9000, (1 << 32) + 5400, 5000 * 300 + 17, 0, 120, True), (0x100, 12600, 12600, None, 120, 50, False), (0x101, 777, 777, None, 0, 30, False)}
