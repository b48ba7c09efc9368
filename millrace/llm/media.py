"""Media columns: MPEG transport streams in a binary column.

A payload is cut into access units of ``UNIT`` bytes. Each becomes one PES packet with a presentation
timestamp, and its 188-byte transport packets carry a continuity counter; the first has an adaptation field
with the random-access indicator and a clock reference. A program association and a program map table lead
the stream. Reading parses both tables (with their CRC), checks every continuity counter, gathers the PES packets of the
stream that the map names and returns the payload, timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import drop, read, table

if TYPE_CHECKING:
    import pyarrow as pa

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, STREAM_PID = 0x0000, 0x0100, 0x0101
PRIVATE, STREAM_ID = 0x06, 0xBD  # stream type and id of private PES data
UNIT, TICKS = 16 * 576, 3600  # bytes of an access unit; 1/25 s of the 90 kHz clock
BLOCK = 576


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint64)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out[i] = c
    return out


_CRC = [int(x) for x in _crc_table()]


def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2 of a table section."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    s = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return s + crc_mpeg(s).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


PAT = _table_packet(PAT_PID, _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT = _table_packet(PMT_PID, _section(0x02, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29) & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _clock(base: int) -> bytes:
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``; an empty payload gives the two tables alone."""
    out, counter = [PAT, PMT], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pts = k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # 8 bytes of the first packet are the adaptation field; what the last one lacks is stuffing
        n = -(-(len(pes) + 8) // 184)
        lack = n * 184 - len(pes) - 8
        m = np.empty((n, PACKET), np.uint8)
        m[:, 0], m[:, 1], m[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF
        m[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter += n
        m[0, 1] |= 0x40
        m[0, 3] |= 0x20
        body = np.frombuffer(pes, np.uint8)
        if n == 1:
            m[0, 4:12] = np.frombuffer(bytes([7 + lack, 0x50]) + _clock(pts), np.uint8)
            m[0, 12 : 12 + lack] = 255
            m[0, 12 + lack :] = body
        else:
            m[0, 4:12] = np.frombuffer(bytes([7, 0x50]) + _clock(pts), np.uint8)
            m[0, 12:] = body[:176]
            full = body[176 : 176 + 184 * (n - 2)]
            m[1 : n - 1, 4:] = full.reshape(n - 2, 184)
            last = body[176 + 184 * (n - 2) :]
            if lack:
                m[-1, 3] |= 0x20
                m[-1, 4] = lack - 1
                m[-1, 5 : 4 + lack] = 255
                if lack > 1:
                    m[-1, 5] = 0
            m[-1, PACKET - len(last) :] = last
        out.append(m.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    """What one elementary stream of a transport stream holds."""

    payload: bytes
    packets: int  # of the whole transport stream
    stamps: list[int]  # presentation timestamps, of the PES packets that have one
    access: list[int]  # packet numbers with the random-access indicator
    gaps: int  # continuity counters that don't follow
    pes: int = 0
    pid: int = STREAM_PID
    streams: tuple[tuple[int, int, int], ...] = ()  # (program, stream type, PID) of all elementary streams


def _payload_from(rows: np.ndarray) -> np.ndarray:
    """Where each packet's payload begins."""
    return np.where(rows[:, 3] & 0x20, 5 + rows[:, 4].astype(np.int64), 4)


def _section_of(rows: np.ndarray, table_id: int) -> bytes:
    """The body of the first whole section among a PID's packets; it may run over several of them."""
    begin, data = _payload_from(rows), None
    for k in range(len(rows)):
        if not rows[k, 3] & 0x10:
            continue
        body = rows[k, begin[k] :].tobytes()
        if rows[k, 1] & 0x40:
            data = body[1 + body[0] :]
        elif data is not None:
            data += body
        if data is None or len(data) < 3:
            continue
        size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
        if data[0] != table_id:
            data = None
        elif len(data) >= size:
            if crc_mpeg(data[:size]):
                raise ValueError("damaged program table")
            return data[8 : size - 4]
    raise ValueError("no program table")


def _stamp_of(pes: bytes) -> int | None:
    """The presentation timestamp of a PES packet, None where its flag is not set."""
    if not pes[7] & 0x80 or pes[8] < 5:
        return None
    t = pes[9:14]
    return (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1


def programs(m: np.ndarray, pid: np.ndarray) -> list[tuple[int, int, int]]:
    """(program, stream type, PID) of every elementary stream, by the association table and each program's map."""
    pat, out = _section_of(m[pid == PAT_PID], 0x00), []
    for k in range(0, len(pat) - 3, 4):
        number, pmt_pid = int.from_bytes(pat[k : k + 2], "big"), int.from_bytes(pat[k + 2 : k + 4], "big") & 0x1FFF
        if not number:
            continue  # the network's own table
        pmt = _section_of(m[pid == pmt_pid], 0x02)
        at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
        while at + 5 <= len(pmt):
            out.append((number, pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF))
            at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0xFFF)
    return out


def demux(media: bytes, want: int | None = None) -> Stream:
    """Parse a transport stream by its tables and gather one elementary stream: that of PID ``want``, by default the first.

    A PES packet without a length runs to the next one's start. Packets without payload don't count, and neither does one
    packet's repetition. Raises ValueError where sync bytes, tables or PES heads are damaged.
    """
    if len(media) % PACKET or not media:
        raise ValueError("not whole packets")
    m = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (m[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid = (m[:, 1].astype(np.int64) & 31) << 8 | m[:, 2]
    known = programs(m, pid)
    if not known and want is None:
        raise ValueError("no elementary stream")
    want = known[0][2] if want is None else want
    where = np.flatnonzero(pid == want)
    rows = m[where]
    access = where[((rows[:, 3] & 0x20) != 0) & (rows[:, 4] > 0) & ((rows[:, 5] & 0x40) != 0)].tolist()
    rows = rows[(rows[:, 3] & 0x10) != 0]
    gaps = 0
    if len(rows) > 1:
        step = (rows[1:, 3] & 15).astype(np.int64) - (rows[:-1, 3] & 15) & 15
        if (step == 0).any():
            again = np.concatenate(([False], (step == 0) & (rows[1:, 4:] == rows[:-1, 4:]).all(axis=1)))
            rows = rows[~again]
            step = (rows[1:, 3] & 15).astype(np.int64) - (rows[:-1, 3] & 15) & 15
        gaps = int((step != 1).sum())
    begin = _payload_from(rows)
    starts = np.flatnonzero(rows[:, 1] & 0x40).tolist()
    parts, stamps = [], []
    for a, b in zip(starts, [*starts[1:], len(rows)], strict=False):
        # whole packets in between are taken at once
        head, tail = rows[a, begin[a] :].tobytes(), b""
        if b - a > 1:
            even = begin[a + 1 : b] == 4
            if even[:-1].all():
                tail = rows[a + 1 : b - 1, 4:].tobytes() + rows[b - 1, begin[b - 1] :].tobytes()
            else:
                tail = b"".join(rows[k, begin[k] :].tobytes() for k in range(a + 1, b))
        pes = head + tail
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
            raise ValueError("damaged PES head")
        size = int.from_bytes(pes[4:6], "big")
        if (stamp := _stamp_of(pes)) is not None:
            stamps.append(stamp)
        parts.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
    return Stream(b"".join(parts), len(m), stamps, access, gaps, len(parts), want, tuple(known))


def padded(text: str | None) -> bytes:
    """UTF-8 of a text, filled with bytes 255 to a positive multiple of 576."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\xff")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (without padding) and media, the text's bytes as a transport stream in a binary column.

    Null and empty texts are one block of padding. Ids may be null or repeated; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 256):  # streams of bounded number are in memory at once
                part = b.slice(at, 256)
                texts = part.column("_text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "replace")) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(sizes, pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])

    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, "id long, n_bytes long, media binary")


def inspect(media: DataFrame) -> DataFrame:
    """For rows of :func:`encode`: sizes and digests of the payload read back, and of the stream, with its features.

    ``feature`` names packets, PES packets, random-access points, continuity gaps and first and last timestamp;
    ``stamps`` and ``access_points`` are the arrays themselves. A damaged stream raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "stamps", "access_points"]
        for b in batches:
            rows = []
            for key, n, m in zip(b.column("id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media"), strict=True):
                m = m.as_py()
                s = demux(m)
                first, last = (s.stamps[0], s.stamps[-1]) if s.stamps else (0, 0)
                text = f"packets={s.packets};pes={s.pes};rap={len(s.access)};gaps={s.gaps};pts={first}-{last}"
                rows.append((key, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), text, s.stamps, s.access))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, stamps array<long>, access_points array<long>"
    return media.select("id", "n_bytes", "media").mapInArrow(run, schema)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored transport stream, read back: doc_id, sizes, digests, feature, timestamps, random-access points.

    The media column is written to the shared folder and read from there; it goes once its features are written.
    """
    media = table(encode(read(spark, sf_dir, "documents")), "media")
    out = table(inspect(media), "media-features")
    drop(media)
    return out.withColumnRenamed("id", "doc_id")
