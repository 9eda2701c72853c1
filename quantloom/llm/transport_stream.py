"""Media columns: MPEG transport streams (operator 5).

A payload is stored as the elementary stream of a one-program transport stream of 188-byte packets and read
back from there: program tables are parsed, continuity counters checked, elementary packets put together
again, and the time stamps and random-access points of the access units become an index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.common import documents

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID, NULL_PID = 188, 0x47, 0x0000, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
CLOCK = 90_000

# The layout that this writer chooses.
PMT_PID, DATA_PID, PROGRAM = 0x0100, 0x0101, 1
UNIT, RANDOM_ACCESS_EVERY, TICKS = 4096, 8, 3600


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC of program tables: polynomial 0x04C11DB7, all ones at the start, high bit first."""
    value = 0xFFFFFFFF
    for byte in data:
        value = (value << 8 & 0xFFFFFFFF) ^ _CRC[value >> 24 ^ byte]
    return value


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    """Bytes of a packet that holds one section; the continuity counter is still 0."""
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(value: int) -> bytes:
    """A 33-bit time stamp with its marker bits, as in the header of an elementary packet."""
    return bytes([0x21 | value >> 29 & 0x0E, value >> 22 & 0xFF, value >> 14 & 0xFE | 1, value >> 7 & 0xFF, value << 1 & 0xFE | 1])


def write_stream(payload: bytes) -> bytes:
    """The payload as a transport stream: access units of 4096 bytes, each in one elementary packet.

    Every eighth unit is a random-access point: program tables and a clock reference go before it.
    """
    out, counter, tables = [], 0, 0
    for unit, at in enumerate(range(0, len(payload), UNIT)):
        data, stamp = payload[at : at + UNIT], unit * TICKS & (1 << 33) - 1
        body = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(stamp) + data
        extra = b""
        if unit % RANDOM_ACCESS_EVERY == 0:
            for packet in (_PAT, _PMT):
                out.append(packet[:3] + bytes([0x10 | tables]) + packet[4:])
            tables = tables + 1 & 15
            extra = b"\x50" + (stamp << 15 | 0x7E00).to_bytes(6, "big")  # random access, clock reference
        first, place = 0x40, 0
        while place < len(body):
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            part = body[place : place + room]
            if len(part) < room:  # the adaptation field fills the last packet
                missing = room - len(part)
                if extra:
                    extra += b"\xff" * missing
                else:
                    extra = b"\x00".ljust(missing - 1, b"\xff") if missing > 1 else None
            head = bytes([SYNC, first | DATA_PID >> 8, DATA_PID & 0xFF, (0x10 if extra == b"" else 0x30) | counter])
            field_ = b"" if extra == b"" else b"\x00" if extra is None else bytes([len(extra)]) + extra
            out.append(head + field_ + part)
            place += len(part)
            first, extra, counter = 0, b"", counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)  # program number: PID of its table
    streams: dict[int, int] = field(default_factory=dict)  # PID: stream type
    continuity_errors: int = 0
    table_errors: int = 0
    duplicates: int = 0
    units: list[tuple[int, int, int, bool]] = field(default_factory=list)  # payload offset, packet, time stamp, random access


def _tables(found: Stream, pid: int, section: bytes) -> None:
    """One section of a program table; a damaged one counts as error and changes nothing."""
    if section_crc(section):
        found.table_errors += 1
    elif pid == PAT_PID and section[0] == 0x00:
        for at in range(8, len(section) - 4, 4):
            if program := int.from_bytes(section[at : at + 2], "big"):
                found.programs[program] = int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
    elif section[0] == 0x02:
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while at + 5 <= len(section) - 4:
            found.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)


class _Sections:
    """Puts the sections of one PID together, which may go over several packets."""

    def __init__(self):
        self.held: bytes | None = None  # None until a section starts

    def take(self, found: Stream, pid: int, data: bytes, begins: bool, lost: bool) -> None:
        if lost:
            self.held = None
        if begins:
            ahead = data[0] if data else 0
            if ahead + 1 > len(data):
                found.table_errors += 1
                self.held = None
                return
            if self.held is not None:
                self._read(found, pid, self.held + data[1 : 1 + ahead])
            self.held = b""
            data = data[1 + ahead :]
        if self.held is not None:
            self.held = self._read(found, pid, self.held + data)

    def _read(self, found: Stream, pid: int, data: bytes) -> bytes:
        """Read the whole sections at the start of data, and return the rest."""
        while len(data) >= 3 and data[0] != 0xFF:
            end = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if end < 12 or end > 1024:
                found.table_errors += 1
                return b"\xff"
            if len(data) < end:
                return data
            _tables(found, pid, data[:end])
            data = data[end:]
        return data if len(data) < 3 and data[:1] != b"\xff" else b"\xff"


def read_stream(media: bytes) -> Stream:
    """Parse a transport stream of one elementary stream: tables, counters, packets, time stamps.

    Damage is counted and passed over: packets without sync byte or with an impossible adaptation field, and
    jumps of a continuity counter that no discontinuity flag announces, are continuity errors; a packet that
    repeats the one before is a duplicate and adds nothing; an elementary packet whose header is cut off or
    wrong has no time stamp (-1), and what follows its fixed part is payload. Bytes after the last whole packet
    are left out. Never raises.
    """
    found, last, parts, sections = Stream(packets=len(media) // PACKET), {}, [], {}
    before: dict[int, bytes] = {}
    size = 0
    for number in range(found.packets):
        at = number * PACKET
        end = at + PACKET
        if media[at] != SYNC or media[at + 1] & 0x80:
            found.continuity_errors += 1
            continue
        pid, flags = (media[at + 1] & 0x1F) << 8 | media[at + 2], media[at + 3]
        if pid == NULL_PID:
            continue
        start, random_access, announced = at + 4, False, False
        if flags & 0x20:
            length = media[start]
            if length > PACKET - 5:
                found.continuity_errors += 1
                continue
            if length:
                random_access, announced = bool(media[start + 1] & 0x40), bool(media[start + 1] & 0x80)
            start += 1 + length
        if not flags & 0x10:
            continue
        counter, lost, packet = flags & 15, False, media[at:end]
        if pid in last and not announced:
            if counter == last[pid] and packet == before[pid]:
                found.duplicates += 1
                continue
            lost = counter != last[pid] + 1 & 15
            found.continuity_errors += lost
        last[pid], before[pid] = counter, packet
        begins = bool(media[at + 1] & 0x40)
        if pid == PAT_PID or pid in found.programs.values():
            sections.setdefault(pid, _Sections()).take(found, pid, media[start:end], begins, lost)
        elif pid in found.streams:
            if begins:
                head, stamp = media[start : min(start + 14, end)], -1
                if len(head) >= 9 and head[:3] == b"\x00\x00\x01":
                    if head[7] & 0x80 and head[8] >= 5 and len(head) == 14:
                        stamp = (head[9] & 0x0E) << 29 | head[10] << 22 | (head[11] & 0xFE) << 14 | head[12] << 7 | head[13] >> 1
                    start = min(start + 9 + head[8], end)
                found.units.append((size, number, stamp, random_access))
            parts.append(media[start:end])
            size += end - start
    found.payload = b"".join(parts)
    return found


def padded(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\x00")


def features(found: Stream) -> str:
    """Packets, units, random-access points, errors, duplicates, last time stamp in ms; mean and spread of the payload's
    bytes and their share above ASCII, all from what was read back."""
    data = np.frombuffer(found.payload, np.uint8)
    counts = np.bincount(data, minlength=256)
    n, values = max(1, len(data)), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = (int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    return f"packets={found.packets};units={len(found.units)};random_access={sum(u[3] for u in found.units)};continuity_errors={found.continuity_errors};table_errors={found.table_errors};duplicates={found.duplicates};last_ms={found.units[-1][2] * 1000 // CLOCK if found.units else -1};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f};high={int(counts[128:].sum()) / n:.4f}"


_UNITS = "units array<struct<payload_offset: bigint, packet: bigint, pts: bigint, random_access: boolean>>"
_INDEX = pa.list_(pa.struct([("payload_offset", pa.int64()), ("packet", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_())]))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Each text stored as a transport stream and read back from it.

    With digest=False: (id, n_bytes, media binary, units array<struct<payload_offset, packet, pts,
    random_access>>, continuity_errors, table_errors, feature). With digest=True the stored form and the
    payload read back stay in the task that made them, and their sizes and checksums are returned, with units.

    The payload is the text in UTF-8 with zero bytes up to a positive multiple of 64; n_bytes leaves those
    out. Equal texts give equal streams: all time stamps count from the start of the payload. A null or empty
    text is 64 zero bytes; an empty table gives no rows; rows that repeat an id, or have none, are treated each;
    other columns are left alone. Damaged streams are read as far as they go (see read_stream). Nothing is shuffled: each row costs in proportion to its text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if digest:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "units"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _INDEX]
        schema = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, {_UNITS}"
    else:
        names = ["n_bytes", "media", "units", "continuity_errors", "table_errors", "feature"]
        kinds = [pa.int64(), pa.binary(), _INDEX, pa.int64(), pa.int64(), pa.string()]
        schema = f"`{id_col}` {kind}, n_bytes bigint, media binary, {_UNITS}, continuity_errors bigint, table_errors bigint, feature string"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, rows = batch.slice(first, 256), []
                for text in part.column(1):
                    raw = (text.as_py() or "").encode()
                    media = write_stream(padded(raw))
                    back = read_stream(media)
                    index = [dict(zip(("payload_offset", "packet", "pts", "random_access"), u, strict=True)) for u in back.units]
                    if digest:
                        rows.append((len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back), index))
                    else:
                        rows.append((len(raw), media, index, back.continuity_errors, back.table_errors, features(back)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(convert, schema)


def stored_payload(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, payload) read back from a table that media_columns made."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([read_stream(x.as_py() or b"").payload for x in part.column(1)], pa.binary())], names=[id_col, "payload"])

    return media.select(id_col, "media").mapInArrow(read, f"`{id_col}` {kind}, payload binary")


def op5_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, and for each access unit its time stamp, place and whether it is a random-access point."""
    return media_columns(documents(spark, sf_dir), digest=True)
