"""Media columns: byte payloads carried in MPEG transport streams.

``mux`` writes a program (PAT, PMT, one private-data elementary stream of PES packets with PTS, PCR and random-access
flags); ``demux`` reads one back: it parses the program tables, checks every PID's continuity counters, reassembles the
elementary packets and lists their timestamps, clock references and random-access points.

Defined cases: a null text counts as empty; an empty payload is 64 zero bytes; equal texts give equal streams (nothing
depends on the row or on time). ``demux`` raises ``ValueError`` for a stream that is not a whole number of packets, has lost
sync, no program or a wrong table checksum, for an adaptation field that does not fit its packet, and for an elementary
packet that has no start code, a header that contradicts itself, or another length than it says. With ``strict=False`` the
elementary packets that are damaged are counted and left out, and so is data before the first of them. A packet that is
sent twice in a row, as the standard allows, counts once; other gaps of a continuity counter are counted, unless the
packet announces one.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import bounded_batches

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, NULL_PID = 0x1000, 0x0100, 0x1FFF
STREAM_TYPE_PRIVATE, STREAM_ID_PRIVATE_1 = 0x06, 0xBD
#: Payload bytes of a PES packet, 90 kHz ticks between two of them, and how many lie between random-access points.
UNIT_BYTES, UNIT_TICKS, UNITS_PER_ACCESS = 16384, 3600, 4
ALIGN = 64


def crc32_mpeg(data: bytes) -> int:
    """The table checksum of program tables: polynomial 0x04C11DB7, most significant bit first, no final inversion."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
        crc &= 0xFFFFFFFF
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    """A program table section with its header and checksum, as the payload of one packet (pointer field first)."""
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 0xFF, extension >> 8, extension & 0xFF, 0xC1, 0, 0])
    section = head + body
    section += crc32_mpeg(section).to_bytes(4, "big")
    return (b"\0" + section).ljust(184, b"\xff")


PAT = _section(0x00, 1, bytes([0, 1, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF]))
PMT = _section(0x02, 1, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0, STREAM_TYPE_PRIVATE, 0xE0 | DATA_PID >> 8, DATA_PID & 0xFF, 0xF0, 0]))


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def _pcr_bytes(ticks: int) -> bytes:
    """Clock reference: 33 bits of 90 kHz ticks, 6 reserved bits, 9 bits of extension."""
    return ((ticks & (1 << 33) - 1) << 15 | 0x3F << 9).to_bytes(6, "big")


def _table_packet(pid: int, counter: int, payload: bytes) -> bytes:
    return bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15]) + payload


def _unit_packets(unit: bytes, pts: int, access: bool, counter: int) -> np.ndarray:
    """The packets of one PES packet: the first has an adaptation field with flags (and the clock), the last is stuffed."""
    pes_length = len(unit) + 8
    pes = b"\0\0\1" + bytes([STREAM_ID_PRIVATE_1, pes_length >> 8, pes_length & 0xFF, 0x84, 0x80, 5]) + _pts_bytes(pts) + unit
    first_field = b"\x50" + _pcr_bytes(pts) if access else b"\x00"
    room = 184 - 1 - len(first_field)
    count = 1 + max(0, -(-(len(pes) - room) // 184))
    packets = np.full((count, PACKET), 0xFF, np.uint8)
    packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    packets[:, 3] = 0x10 | (counter + np.arange(count)) & 15
    packets[0, 1] |= 0x40
    data = np.frombuffer(pes, np.uint8)
    head = data[:room]
    stuffed = room - len(head)  # only where the whole PES packet fits in the first one
    packets[0, 3] |= 0x20
    packets[0, 4] = len(first_field) + stuffed
    packets[0, 5 : 5 + len(first_field)] = np.frombuffer(first_field, np.uint8)
    packets[0, PACKET - len(head) :] = head
    full = (len(data) - len(head)) // 184
    if full:
        packets[1 : 1 + full, 4:] = data[room : room + full * 184].reshape(full, 184)
    rest = data[len(head) + full * 184 :]
    if len(rest):
        packets[-1, 3] |= 0x20
        packets[-1, 4] = 183 - len(rest)
        if len(rest) < 183:
            packets[-1, 5] = 0
        packets[-1, PACKET - len(rest) :] = rest
    return packets


def mux(payload: bytes) -> bytes:
    """A transport stream that carries ``payload``; tables are repeated before every random-access point."""
    parts, table_counter, counter = [], 0, 0
    for number, start in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        access = number % UNITS_PER_ACCESS == 0
        if access:
            parts += [_table_packet(0, table_counter, PAT), _table_packet(PMT_PID, table_counter, PMT)]
            table_counter += 1
        packets = _unit_packets(payload[start : start + UNIT_BYTES], number * UNIT_TICKS, access, counter)
        counter += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Program:
    """What a stream holds: its payload, and for each PES packet its timestamp, first TS packet and random-access flag."""

    payload: bytes = b""
    pts: list[int] = field(default_factory=list)
    packet: list[int] = field(default_factory=list)
    access: list[bool] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    pcr: list[int] = field(default_factory=list)
    packets: int = 0
    table_packets: int = 0
    continuity_errors: int = 0
    repeated_packets: int = 0
    damaged: int = 0
    stream_type: int = -1


def _table(packets: np.ndarray, rows: np.ndarray, starts: np.ndarray, table_id: int) -> bytes:
    """Body of the first section with this id among the rows; its checksum must hold."""
    for row in rows:
        payload = packets[row, starts[row] :].tobytes()
        section = payload[1 + payload[0] :]
        if section[:1] != bytes([table_id]):
            continue
        section = section[: 3 + ((section[1] & 0x0F) << 8 | section[2])]
        if crc32_mpeg(section):
            raise ValueError("wrong checksum in a program table")
        return section[8:-4]
    raise ValueError(f"no program table {table_id}")


def _in_sequence(packets: np.ndarray, rows: np.ndarray, announced: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of one PID's payload packets (their ``rows``) count, without those sent twice, and the gaps of their counter."""
    step = np.diff((packets[rows, 3] & 15).astype(np.int8)) & 15
    # a second copy may differ in its clock reference alone, which stands behind the adaptation field's flags
    same = (packets[rows[1:]] == packets[rows[:-1]]).copy()
    same[:, 6:12] |= (packets[rows[1:], 3] & 0x20 != 0)[:, None] & (packets[rows[1:], 4] >= 7)[:, None] & (packets[rows[1:], 5] & 0x10 != 0)[:, None]
    repeated = (step == 0) & same.all(1)
    # of three equal packets in a row the third is no legal copy
    repeated[1:] &= ~repeated[:-1]
    gaps = (step != 1) & ~repeated & ~announced[rows[1:]]
    return np.concatenate([[True], ~repeated])[: len(rows)], int(gaps.sum())


#: Header bytes that each flag of an elementary packet stands for, without the timestamps.
HEADER_PARTS = ((0x20, 6), (0x10, 3), (0x08, 1), (0x04, 1), (0x02, 2))
MOST_STUFFING = 32


def _timestamp(p: bytes) -> int:
    if len(p) < 5 or not (p[0] & 1 and p[2] & 1 and p[4] & 1) or p[0] >> 5 != 1:
        raise ValueError("a timestamp without its marks")
    return (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1


def _unit(pes: bytes) -> tuple[bytes, int]:
    """Data and timestamp (-1 for none) of an elementary packet, whose lengths must agree with each other."""
    if pes[:3] != b"\0\0\1":
        raise ValueError("no PES start code")
    if len(pes) < 9 or pes[6] & 0xC0 != 0x80:
        raise ValueError("no PES header")
    length, flags, header = pes[4] << 8 | pes[5], pes[7], pes[8]
    if length and len(pes) != length + 6:
        raise ValueError(f"a PES packet of {len(pes)} bytes says {length + 6}")
    known = {0x80: 5, 0xC0: 10}.get(flags & 0xC0, 0) + sum(n for flag, n in HEADER_PARTS if flags & flag)
    stuffing = header - known
    if stuffing < 0 or 9 + header > len(pes) or not flags & 1 and (stuffing > MOST_STUFFING or pes[9 + known : 9 + header] != b"\xff" * stuffing):
        raise ValueError("a PES header of wrong length")
    return pes[9 + header :], _timestamp(pes[9:14]) if flags & 0x80 else -1


def demux(stream: bytes, strict: bool = True) -> Program:
    if len(stream) % PACKET or not stream:
        raise ValueError("not a whole number of packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    begins, control = packets[:, 1] & 0x40 != 0, packets[:, 3] >> 4 & 3
    has_field, has_payload = control & 2 != 0, control & 1 != 0
    fields = packets[:, 4].astype(np.int32)
    if (has_field & (fields > np.where(has_payload, 182, 183))).any():
        raise ValueError("an adaptation field does not fit its packet")
    starts = np.where(has_payload, np.where(has_field, 5 + fields, 4), PACKET)
    flags = np.where(has_field & (fields > 0), packets[:, 5], 0)
    found = Program(packets=len(packets))

    associations = _table(packets, np.flatnonzero((pid == 0) & begins), starts, 0x00)
    programs = [associations[i : i + 4] for i in range(0, len(associations), 4)]
    pmt_pid = next((((p[2] & 0x1F) << 8 | p[3]) for p in programs if p[:2] != b"\0\0"), None)
    if pmt_pid is None:
        raise ValueError("no program")
    program = _table(packets, np.flatnonzero((pid == pmt_pid) & begins), starts, 0x02)
    clock_pid = (program[0] & 0x1F) << 8 | program[1]
    streams = program[4 + ((program[2] & 0x0F) << 8 | program[3]) :]
    if len(streams) < 5:
        raise ValueError("no elementary stream")
    found.stream_type, data_pid = streams[0], (streams[1] & 0x1F) << 8 | streams[2]
    found.table_packets = int(((pid == 0) | (pid == pmt_pid)).sum())

    for one in (0, pmt_pid, data_pid):
        rows = np.flatnonzero((pid == one) & has_payload)
        counted, gaps = _in_sequence(packets, rows, flags & 0x80 != 0)
        found.continuity_errors += gaps
        found.repeated_packets += int((~counted).sum())
    rows = rows[counted]  # the data's

    for row in np.flatnonzero((pid == clock_pid) & (flags & 0x10 != 0) & (fields >= 7)):
        base = int.from_bytes(packets[row, 6:12].tobytes(), "big")
        found.pcr.append((base >> 15) * 300 + (base & 0x1FF))

    own, own_starts = packets[rows], starts[rows]
    data = own[np.arange(PACKET) >= own_starts[:, None]].tobytes()
    offsets = np.concatenate([[0], np.cumsum(PACKET - own_starts)])
    firsts = np.flatnonzero(begins[rows])
    if not len(firsts) or firsts[0]:
        if strict:
            raise ValueError("data before the first PES packet" if len(rows) else "no data")
        found.damaged += 1
    units = []
    for i, row in enumerate(firsts):
        end = offsets[firsts[i + 1]] if i + 1 < len(firsts) else len(data)
        try:
            unit, pts = _unit(data[offsets[row] : end])
        except ValueError:
            if strict:
                raise
            found.damaged += 1
            continue
        found.pts.append(pts)
        found.packet.append(int(rows[row]))
        found.access.append(bool(flags[rows[row]] & 0x40))
        units.append(unit)
        found.sizes.append(len(unit))
    found.payload = b"".join(units)
    return found


def padded(text: str | None) -> bytes:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(ALIGN, -(-len(data) // ALIGN) * ALIGN), b"\0")


@F.pandas_udf(T.BinaryType())
def mux_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: mux(padded(text)))


SUMMARY = (
    T.StructType().add("payload_bytes", T.LongType()).add("payload_sha256", T.StringType()).add("tail_crc32", T.LongType())
    .add("media_bytes", T.LongType()).add("media_sha256", T.StringType()).add("feature", T.StringType())
)


def _summary(media: bytes) -> tuple:
    read = demux(media)
    index = np.array([read.pts, read.packet, read.access, read.sizes], np.int64)
    points = [str(t) for t, a in zip(read.pts, read.access, strict=True) if a]
    feature = (
        f"packets={read.packets};tables={read.table_packets};type={read.stream_type:#04x};units={len(read.pts)};"
        f"pts={min(read.pts)}-{max(read.pts)};access={len(points)};last_access={points[-1] if points else ''};"
        f"pcr={len(read.pcr)}:{read.pcr[-1] if read.pcr else ''};continuity_errors={read.continuity_errors};index_crc32={zlib.crc32(index.tobytes()):08x}"
    )
    return len(read.payload), hashlib.sha256(read.payload).hexdigest(), zlib.crc32(read.payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature


@F.pandas_udf(SUMMARY)
def read_back(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_summary(m) for m in media], columns=SUMMARY.names)


UNITS = T.ArrayType(
    T.StructType().add("unit", T.IntegerType()).add("pts", T.LongType()).add("packet", T.IntegerType())
    .add("random_access", T.BooleanType()).add("data", T.BinaryType())
)


@F.pandas_udf(UNITS)
def _units(media: pd.Series) -> pd.Series:
    def units(stream: bytes | None) -> list[dict]:
        if stream is None:
            return []
        read, at, out = demux(stream), 0, []
        for i, size in enumerate(read.sizes):
            out.append({"unit": i, "pts": read.pts[i], "packet": read.packet[i], "random_access": read.access[i], "data": read.payload[at : at + size]})
            at += size
        return out

    return media.map(units)


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with the binary column ``out``: each text's transport stream. A column of that name is replaced."""
    bounded_batches(df.sparkSession)
    return df.withColumn(out, mux_text(F.col(text)))


def access_units(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per elementary packet of each stream, beside the other columns of ``df``: unit, pts, packet,
    random_access, data. A null stream gives no row."""
    bounded_batches(df.sparkSession)
    others = [F.col(f"`{c}`") for c in df.columns if c != media and c not in ("unit", "pts", "packet", "random_access", "data")]
    return df.select(*others, F.inline(_units(F.col(media))))


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text stored as a transport stream, read back from the stored bytes and summed up."""
    stored = with_media(docs.select("doc_id", "text"))
    read = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), read_back("media").alias("read"))
    return read.select("doc_id", "n_bytes", "read.*")
