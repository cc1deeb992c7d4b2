"""MPEG transport streams in binary columns.

Writing: bytes become the access units of one private stream, with a program association and a
program map table, PES headers with timestamps, continuity counters and random-access flags.
Reading: tables are parsed and their checksums verified, continuity is checked for each PID, PES
packets are put together, and each access unit's timestamps, clock reference, place and random-access flag are stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the format.
PACKET, SYNC, NULL_PID, PRIVATE_STREAM, PRIVATE_TYPE, TICKS = 188, 0x47, 0x1FFF, 0xBD, 0x06, 3600
MAP_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
#: Payload bytes of an access unit, and how many of them share a random-access point.
UNIT, KEY_EVERY = 1536, 8


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1) ^ (0x04C11DB7 if value & 0x80000000 else 0)
        table.append(value & 0xFFFFFFFF)
    return table


CRC = _crc_table()


def section_crc(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = ((value << 8) & 0xFFFFFFFF) ^ CRC[(value >> 24) ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | MAP_PID).to_bytes(2, "big"))) + _table_packet(
    MAP_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _timestamp(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | (ticks >> 29) & 0x0E]) + ((ticks >> 14) & 0xFFFE | 1).to_bytes(2, "big") + ((ticks << 1) & 0xFFFE | 1).to_bytes(2, "big")


def write_stream(payload: bytes) -> bytes:
    """A transport stream whose private stream carries payload."""
    out, counter = [TABLES], 0
    start, plain = bytes([SYNC]) + (0x4000 | DATA_PID).to_bytes(2, "big"), bytes([SYNC]) + DATA_PID.to_bytes(2, "big")
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _timestamp(k * TICKS) + unit
        spot = 0
        while spot < len(pes):
            need, room = len(pes) - spot, 184 - 2 * (not spot)
            take = min(need, room)
            flags = 0x40 if not spot and k % KEY_EVERY == 0 else 0
            if not spot or take < 184:
                size = 183 - take  # of the adaptation field after its length byte
                fill = bytes([size]) + (bytes([flags]) + b"\xff" * (size - 1) if size else b"")
                head = (plain if spot else start) + bytes([0x30 | counter]) + fill
            else:
                head = plain + bytes([0x10 | counter])
            out += (head, pes[spot : spot + take])
            spot, counter = spot + take, (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    kind: int = -1
    counter: int = -1
    last: bytes = b""
    pes: list[bytes] = field(default_factory=list)
    key: bool = False
    clock: int | None = None
    whole: bool = False
    data: list[bytes] = field(default_factory=list)
    size: int = 0


def _sections(held: bytes) -> Iterator[bytes]:
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0xFFF)
        if len(held) < size:
            return
        yield held[:size]
        held = held[size:]


def parse_stream(media: bytes) -> dict:
    """Programs, streams, access units, counts of errors and the data of each elementary stream.

    Packets without the sync byte, with the error flag or scrambled are skipped and counted; a repeated packet is ignored; a
    gap in a PID's counter without the discontinuity flag is counted and drops the open PES packet, as does a
    length that doesn't hold; tables of a wrong checksum are counted and not used.
    """
    programs: dict[int, int] = {}
    streams: dict[int, Stream] = {}
    tables: dict[int, bytes] = {}
    counters: dict[int, tuple[int, bytes]] = {}
    units: list[dict] = []
    bad = {"packets": len(media) % PACKET > 0, "continuity": 0, "tables": 0, "pes": 0}

    def finish(pid: int) -> None:
        s = streams[pid]
        pes, s.pes = b"".join(s.pes), []
        if not pes:
            return
        size = int.from_bytes(pes[4:6], "big")
        if not s.whole or len(pes) < 9 or pes[:3] != b"\x00\x00\x01" or (size and size + 6 != len(pes)) or len(pes) < 9 + pes[8]:
            bad["pes"] += 1
            return
        ticks = lambda at: ((pes[at] >> 1) & 7) << 30 | pes[at + 1] << 22 | (pes[at + 2] >> 1) << 15 | pes[at + 3] << 7 | pes[at + 4] >> 1
        pts = ticks(9) if pes[7] & 0x80 and pes[8] >= 5 else None
        dts = ticks(14) if pes[7] & 0xC0 == 0xC0 and pes[8] >= 10 else pts
        data = pes[9 + pes[8] :]
        units.append({"pid": pid, "pts": pts, "dts": dts, "pcr": s.clock, "offset": s.size, "size": len(data), "random_access": s.key})
        s.data.append(data)
        s.size += len(data)

    def read_tables(pid: int) -> None:
        for section in _sections(tables[pid]):
            if len(section) < 12 or section_crc(section):
                bad["tables"] += 1
                continue
            body = section[8:-4]
            if pid == 0 and section[0] == 0:
                for k in range(0, len(body) - 3, 4):
                    number, place = int.from_bytes(body[k : k + 2], "big"), int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF
                    if number:
                        programs[number] = place
            elif section[0] == 2:
                k = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
                while k + 5 <= len(body):
                    own = int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF
                    streams.setdefault(own, Stream()).kind = body[k]
                    k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0xFFF)

    for at in range(0, len(media) - PACKET + 1, PACKET):
        packet = media[at : at + PACKET]
        if packet[0] != SYNC or packet[1] & 0x80 or packet[3] & 0xC0:
            bad["packets"] += 1
            continue
        pid, control, counter = (packet[1] & 0x1F) << 8 | packet[2], packet[3] >> 4 & 3, packet[3] & 15
        if pid == NULL_PID or not control & 1:
            continue
        begin, flags = 4, 0
        if control & 2:
            begin, flags = 5 + packet[4], packet[5] if packet[4] else 0
        before = counters.get(pid)
        if before and before[0] == counter and before[1] == packet:
            continue
        gap = before is not None and counter != (before[0] + 1) & 15 and not flags & 0x80
        counters[pid] = (counter, packet)
        bad["continuity"] += gap
        first, payload = packet[1] & 0x40, packet[begin:]
        if pid == 0 or pid in programs.values():
            if first and payload:
                tables[pid] = payload[1 + payload[0] :]
            elif pid in tables and not gap:
                tables[pid] += payload
            if pid in tables:
                read_tables(pid)
        elif pid in streams:
            s = streams[pid]
            if gap:
                s.whole = False
            if first:
                finish(pid)
                s.key, s.whole, s.clock = bool(flags & 0x40), True, None
                if flags & 0x10 and packet[4] >= 7:  # 33 bits of 90 kHz, six reserved, nine of 27 MHz
                    clock = int.from_bytes(packet[6:12], "big")
                    s.clock = (clock >> 15) * 300 + (clock & 0x1FF)
            if first or s.pes:
                s.pes.append(payload)
    for pid in streams:
        finish(pid)
    return {
        "programs": [{"program": n, "pid": p} for n, p in sorted(programs.items())],
        "streams": [{"pid": p, "type": s.kind, "bytes": s.size} for p, s in sorted(streams.items())],
        "units": units,
        "bad_packets": int(bad["packets"]),
        "continuity_errors": bad["continuity"],
        "bad_tables": bad["tables"],
        "bad_pes": bad["pes"],
        "data": b"".join(b for _, s in sorted(streams.items()) for b in s.data),
    }


PARSED = (
    "programs array<struct<program:int,pid:int>>, streams array<struct<pid:int,type:int,bytes:long>>, "
    "units array<struct<pid:int,pts:long,dts:long,pcr:long,offset:long,size:long,random_access:boolean>>, "
    "bad_packets long, continuity_errors long, bad_tables long, bad_pes long, data binary"
)
ARROW = {
    "programs": pa.list_(pa.struct([("program", pa.int32()), ("pid", pa.int32())])),
    "streams": pa.list_(pa.struct([("pid", pa.int32()), ("type", pa.int32()), ("bytes", pa.int64())])),
    "units": pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("dts", pa.int64()), ("pcr", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("random_access", pa.bool_())])),
    **dict.fromkeys(("bad_packets", "continuity_errors", "bad_tables", "bad_pes"), pa.int64()),
    "data": pa.binary(),
}


def _with(rows: DataFrame, column: str, kept: bool, new: str, make) -> DataFrame:
    """rows with a binary column last, and from it new columns; a few hundred values are held at a time."""
    first = [c for c in rows.columns if c != column]
    fields = [*rows.select(*first, *[column] * kept).schema.fields, *T.StructType.fromDDL(new).fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = make([v or b"" for v in part.column(len(first)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(first) + kept], *found], [f.name for f in fields])

    return rows.select(*first, column).mapInArrow(apply, T.StructType(fields))


def write_column(rows: DataFrame) -> DataFrame:
    """rows with `media` in place of the binary column `payload`; a null payload is empty: tables without access units.

    Very long values are streams as long as themselves and are held one batch of 256 at a time; other columns, repeated rows and empty tables pass through.
    """
    return _with(rows, "payload", False, "media binary", lambda values: [pa.array([write_stream(v) for v in values], pa.binary())])


def parse_column(rows: DataFrame) -> DataFrame:
    """rows with the columns of PARSED after the binary column `media`. A null is an empty stream; any bytes parse, with errors counted; other columns, repeated rows and empty tables pass through."""

    def parse(values: list[bytes]) -> list[pa.Array]:
        found = [parse_stream(v) for v in values]
        return [pa.array([f[k] for f in found], t) for k, t in ARROW.items()]

    return _with(rows, "media", True, PARSED, parse)


def unit_index(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, unit, pid, pts, dts, pcr, offset, size, random_access): a row for each access unit, counted from 0; to seek, take the last random-access unit up to a timestamp."""
    return parsed.select(*keys, F.posexplode("units").alias("unit", "u")).select(*keys, "unit", "u.*")
