"""Media columns: texts stored in, and read back from, MPEG transport streams.

A payload becomes access units of UNIT_BYTES; each is one PES packet with a
presentation timestamp, cut into 188-byte packets. Every RAP_EVERY-th unit is a
random-access point: the tables (PAT, PMT) are repeated before it, and its first
packet has the random-access flag and a clock reference. demux() is a reader for
any stream of that kind: it resynchronises, parses program tables, checks
continuity counters, drops repeated packets and reassembles PES packets.

Null or empty text: a payload of 192 spaces. Equal texts give equal bytes. Long
texts are handled one at a time; nothing is cut. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices

PACKET = 188
BLOCK = 192  # payloads are padded with spaces to a positive multiple of this
UNIT_BYTES = 192 * 48
RAP_EVERY = 8
TICKS = 3600  # of the 90 kHz clock, between two units
PMT_PID, DATA_PID = 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD  # stream type and PES stream id of private data


def _mpeg_crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _mpeg_crc_table()


def mpeg_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, section: bytes) -> np.ndarray:
    section += mpeg_crc(section).to_bytes(4, "big")
    head = bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


def _program_tables() -> np.ndarray:
    pat = bytes([0x00, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 255])
    pmt = bytes([0x02, 0xB0, 18, 0, 1, 0xC1, 0, 0, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, PRIVATE_DATA, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])
    return np.stack([_section_packet(0, pat), _section_packet(PMT_PID, pmt)])


_TABLES = _program_tables()


def _clock(value: int, mark: int) -> bytes:
    """A 33-bit timestamp in the five bytes of a PES header."""
    return bytes([mark << 4 | (value >> 29 & 14) | 1, value >> 22 & 255, (value >> 14 & 254) | 1, value >> 7 & 255, (value << 1 & 254) | 1])


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream of one program with one private stream."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT_BYTES)):
        unit, pts, rap = payload[at : at + UNIT_BYTES], k * TICKS & (1 << 33) - 1, k % RAP_EVERY == 0
        if rap:
            tables = _TABLES.copy()
            tables[:, 3] |= (k // RAP_EVERY) & 15
            out.append(tables.tobytes())
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _clock(pts, 2) + unit
        pcr = bytes([0x50, pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255, (pts & 1) << 7 | 0x7E, 0]) if rap else b""
        room = PACKET - 4 - (len(pcr) + 1 if pcr else 0)
        n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = counter + n & 15
        body = np.frombuffer(pes, np.uint8)
        first = min(room, len(body)) if n > 1 else len(body)
        if n > 1:
            packets[0, PACKET - first :] = body[:first]
            middle = body[first : first + (n - 2) * (PACKET - 4)]
            packets[1 : n - 1, 4:] = middle.reshape(n - 2, PACKET - 4)
            last = body[first + len(middle) :]
        else:
            last = body
        packets[n - 1, PACKET - len(last) :] = last
        for row, flags, used in ((0, pcr, first), (n - 1, pcr if n == 1 else b"", len(last))):
            spare = PACKET - 4 - used
            if spare and (row or n == 1 or flags):
                packets[row, 3] |= 0x20
                packets[row, 4] = spare - 1
                if flags:
                    packets[row, 5 : 5 + len(flags)] = np.frombuffer(flags, np.uint8)
                elif spare > 1:
                    packets[row, 5] = 0
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Unit:
    """One PES packet: where its data starts in its stream's data, and its length."""

    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    offset: int
    length: int


@dataclass
class Stream:
    pid: int
    kind: int | None
    units: list[Unit] = field(default_factory=list)
    data: bytes = b""


@dataclass
class Demuxed:
    programs: dict[int, int]  # program number to PID of its map
    streams: dict[int, Stream]
    packets: int
    continuity_errors: int
    repeated: int
    damaged: int  # bytes skipped to resynchronise, packets flagged as errors, PES packets cut short


def _aligned(data: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows; bytes without a packet around them are skipped and counted."""
    raw, n = np.frombuffer(data, np.uint8), len(data) // PACKET
    if len(data) % PACKET == 0 and (raw[::PACKET] == 0x47).all():
        return raw.reshape(n, PACKET), 0
    rows, at = [], 0
    while at + PACKET <= len(data):
        if data[at] == 0x47 and (at + PACKET == len(data) or at + PACKET < len(data) and data[at + PACKET] == 0x47):
            rows.append(at)
            at += PACKET
        else:
            at += 1
    grid = np.array(rows, np.int64)[:, None] + np.arange(PACKET)
    return (raw[grid] if rows else np.zeros((0, PACKET), np.uint8)), len(data) - PACKET * len(rows)


def _sections(chunks: list[tuple[bool, bytes]]) -> list[bytes]:
    """Whole sections with a right CRC, from (starts a section, payload) in order."""
    out, held = [], None
    for starts, body in chunks:
        if starts:
            skip = body[0] if body else 0
            pieces = [(held + body[1 : 1 + skip]) if held is not None else b"", body[1 + skip :]]
        elif held is not None:
            pieces = [held + body]
        else:
            continue
        held = None
        for piece in pieces:
            while len(piece) >= 3 and piece[0] != 0xFF:
                size = 3 + ((piece[1] & 15) << 8 | piece[2])
                if len(piece) < size:
                    held = piece
                    break
                if mpeg_crc(piece[:size]) == 0:
                    out.append(piece[:size])
                piece = piece[size:]
    return out


def _timestamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def demux(data: bytes) -> Demuxed:
    """Program tables, streams with their access units, and the faults found on the way."""
    grid, damaged = _aligned(data)
    total = len(grid)
    bad = (grid[:, 1] & 0x80) > 0
    damaged += int(bad.sum())
    grid = grid[~bad]
    pid = (grid[:, 1].astype(np.int32) & 31) << 8 | grid[:, 2]
    starts, control, counter = (grid[:, 1] & 0x40) > 0, grid[:, 3] >> 4 & 3, grid[:, 3] & 15
    adapted = (control & 2) > 0
    offset = np.where(adapted, 5 + grid[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (grid[:, 4] > 0), grid[:, 5], 0)
    out = Demuxed({}, {}, total, 0, 0, damaged)

    def rows_of(which: int) -> np.ndarray:
        """Rows with payload of one PID, after the continuity check; a repeated packet counts once."""
        rows = np.flatnonzero((pid == which) & ((control & 1) > 0) & (offset <= PACKET))
        if len(rows) < 2:
            return rows
        step = (counter[rows[1:]].astype(np.int32) - counter[rows[:-1]]) & 15
        again = (step == 0) & (grid[rows[1:], 4:] == grid[rows[:-1], 4:]).all(1)
        jump = (step != 1) & ~again & ((flags[rows[1:]] & 0x80) == 0)
        out.repeated += int(again.sum())
        out.continuity_errors += int(jump.sum())
        return rows[np.concatenate(([True], ~again))]

    def chunks(which: int) -> list[tuple[bool, bytes]]:
        return [(bool(starts[r]), grid[r, offset[r] :].tobytes()) for r in rows_of(which)]

    for s in _sections(chunks(0)):
        if s[0] == 0x00:
            for i in range(8, len(s) - 4, 4):
                if number := s[i] << 8 | s[i + 1]:
                    out.programs[number] = (s[i + 2] & 31) << 8 | s[i + 3]
    for map_pid in dict.fromkeys(out.programs.values()):
        for s in _sections(chunks(map_pid)):
            i = 12 + ((s[10] & 15) << 8 | s[11])
            while s[0] == 0x02 and i + 5 <= len(s) - 4:
                p = (s[i + 1] & 31) << 8 | s[i + 2]
                out.streams.setdefault(p, Stream(p, s[i]))
                i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for p, stream in out.streams.items():
        rows = rows_of(p)
        begin = np.flatnonzero(starts[rows])
        if not len(begin):
            continue
        rows = rows[begin[0] :]
        begin -= begin[0]
        cut = offset[rows]
        body = grid[rows][np.arange(PACKET) >= cut[:, None]].tobytes()
        edge = np.concatenate(([0], np.cumsum(PACKET - cut)))
        ends = [*begin[1:].tolist(), len(rows)]
        parts, at = [], 0
        for a, b in zip(begin.tolist(), ends, strict=True):
            pes = body[edge[a] : edge[b]]
            if len(pes) < 9 or pes[:3] != b"\0\0\1":
                out.damaged += 1
                continue
            said, stamps = pes[4] << 8 | pes[5], pes[7] >> 6
            data_at = 9 + pes[8]
            stop = 6 + said if said else len(pes)
            out.damaged += stop > len(pes)
            part = pes[data_at:stop]
            stream.units.append(Unit(pes[3], _timestamp(pes[9:14]) if stamps & 2 else None, _timestamp(pes[14:19]) if stamps == 3 else None, bool(flags[rows[a]] & 0x40), at, len(part)))
            parts.append(part)
            at += len(part)
        stream.data = b"".join(parts)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: padded with spaces to a positive multiple of BLOCK."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def feature(found: Demuxed) -> str:
    """What a catalogue keeps of a stream: tables, faults, timestamps, random-access points, bytes."""
    parts = [f"programs={len(found.programs)}", f"packets={found.packets}", f"cc={found.continuity_errors}"]
    for s in found.streams.values():
        stamps, raps = [u.pts for u in s.units if u.pts is not None], [u.offset for u in s.units if u.random_access]
        seen = np.bincount(np.frombuffer(s.data, np.uint8), minlength=256)
        share = seen[seen > 0] / max(1, len(s.data))
        parts.append(f"pid={s.pid} type={s.kind} pes={len(s.units)} pts={min(stamps, default=0)}-{max(stamps, default=0)} rap={len(raps)}:{zlib.crc32(str(raps).encode()):08x} entropy={float(-(share * np.log2(share)).sum()):.4f}")
    return " ".join(parts)


def store(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, n_bytes, the stream (media, binary), and its units as read back: pid, pts, dts, random_access, offset, length."""

    def make():
        def one(text):
            n, payload = payload_of(text)
            media = mux(payload)
            units = [{"pid": s.pid, "pts": u.pts, "dts": u.dts, "random_access": u.random_access, "offset": u.offset, "length": u.length} for s in demux(media).streams.values() for u in s.units]
            return n, media, units

        def run(cols):
            rows = [one(t) for t in cols["text"]]
            return {"id": cols["id"], "n_bytes": [r[0] for r in rows], "media": [r[1] for r in rows], "units": [r[2] for r in rows]}

        return run

    return map_slices(df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text"), make, "id bigint, n_bytes bigint, media binary, units array<struct<pid:int,pts:bigint,dts:bigint,random_access:boolean,offset:bigint,length:bigint>>").withColumnRenamed("id", id_column)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, sizes and checksums of what the stored stream of each text gives back, and its feature."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def one(text):
            n, payload = payload_of(text)
            media = mux(payload)
            found = demux(media)
            back = found.streams[DATA_PID].data
            return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)

        def run(cols):
            rows = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return run

    return map_slices(df.select("doc_id", "text"), make, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
