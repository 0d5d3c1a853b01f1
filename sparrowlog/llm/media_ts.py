"""Media columns as MPEG transport streams.

``encode`` stores a payload as a stream of 188-byte packets: program association and program map tables before each
random-access point, and one private elementary stream of access units, each a PES packet with a presentation timestamp
at 25 units a second. ``decode`` parses the tables (sections may span packets; of several programs the one first listed is
read), checks their CRC and the continuity counters (not where a packet flags a discontinuity), reassembles the PES packets
of the first elementary stream and lists timestamps (-1 for a unit that states none) and random-access points.

``store_documents`` writes the streams as a table; ``read_documents`` reads that table and derives payload and features.
Null texts count as the empty text; repeated rows are stored each; equal texts give equal bytes; extra columns are ignored.
A stored stream that is null, empty or damaged beyond reading gives a row with ``error`` and nulls for what it lacks.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlog.llm.common import materialise, utf8

UNIT, ACCESS_UNIT, RAP_EVERY, TICKS = 192, 50 * 192, 8, 3600
PAT_PID, PMT_PID, ES_PID, PROGRAM, PRIVATE = 0, 0x100, 0x101, 1, 0x06
PACKET, BODY, SYNC = 188, 184, 0x47
STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, continuity_errors long, error string"


def pad(data: bytes) -> bytes:
    """The data and spaces up to a positive multiple of 192 bytes."""
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


@lru_cache(256)
def crc32_mpeg(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packet(pid: int, counter: int, data: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | counter % 16, 0]) + data).ljust(PACKET, b"\xff")


def timestamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29) & 0x0E, (ticks >> 22) & 255, 0x01 | (ticks >> 14) & 0xFE, (ticks >> 7) & 255, 0x01 | (ticks << 1) & 0xFE])


def encode(payload: bytes) -> bytes:
    pat = section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = section(2, PROGRAM, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
    out, counter = [], 0
    for unit in range(-(-len(payload) // ACCESS_UNIT)):
        data, pts = payload[unit * ACCESS_UNIT : (unit + 1) * ACCESS_UNIT], unit * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + timestamp(pts) + data
        field = b""
        if unit % RAP_EVERY == 0:
            out += [table_packet(PAT_PID, unit // RAP_EVERY, pat), table_packet(PMT_PID, unit // RAP_EVERY, pmt)]
            field = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        at, first = 0, 0x40
        while at < len(pes):
            room = BODY - (len(field) + 1 if field else 0)
            short = room - (len(pes) - at)
            if short > 0:  # the last packet of the unit: stuffing in the adaptation field
                if not field and short == 1:
                    adapt = b"\x00"
                else:
                    field = (field or b"\x00") + b"\xff" * (short if field else short - 2)
                    adapt = bytes([len(field)]) + field
            else:
                adapt = bytes([len(field)]) + field if field else b""
            n = BODY - len(adapt)
            out.append(bytes([SYNC, first | ES_PID >> 8, ES_PID & 255, (0x30 if adapt else 0x10) | counter]) + adapt + pes[at : at + n])
            at, first, field, counter = at + n, 0, b"", (counter + 1) % 16
    return b"".join(out)


class Sections:
    """Table sections of one packet identifier, put together over packets."""

    def __init__(self):
        self.data = b""

    def add(self, body: bytes, start: bool) -> bytes | None:
        """The section that these bytes complete, if any."""
        self.data = body[1 + body[0] :] if start else self.data and self.data + body
        size = 3 + (int.from_bytes(self.data[1:3], "big") & 0xFFF)
        if len(self.data) < max(size, 4):
            return None
        section_, self.data = self.data[:size], b""
        if crc32_mpeg(section_[:-4]) != int.from_bytes(section_[-4:], "big"):
            raise ValueError("a table's CRC is wrong")
        return section_


def program_map(pat: bytes) -> int | None:
    """Where the first program's map is; program 0 is the network's table."""
    for at in range(8, len(pat) - 4, 4):
        if pat[at : at + 2] != b"\0\0":
            return int.from_bytes(pat[at + 2 : at + 4], "big") & 0x1FFF
    return None


def timestamp_of(pes: bytes) -> int:
    if not pes[7] & 0x80:
        return -1
    p = pes[9:14]
    return (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1


def decode(media: bytes) -> dict:
    """payload, timestamps, random_access (packet numbers), continuity_errors, packets and stream_type of a stream."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    pmt_pid = es_pid = kind = None
    counters: dict[int, int] = {}
    tables = {PAT_PID: Sections()}
    units: list[list[bytes]] = []
    stamps, access, errors = [], [], 0
    for at in range(0, len(media), PACKET):
        if media[at] != SYNC:
            raise ValueError("a packet does not begin with the sync byte")
        pid, control = (media[at + 1] & 31) << 8 | media[at + 2], media[at + 3]
        begin, start, broken = at + 4, bool(media[at + 1] & 0x40), False
        if control & 0x20:
            if media[at + 4]:
                broken = bool(media[at + 5] & 0x80)
                if media[at + 5] & 0x40 and pid == es_pid:
                    access.append(at // PACKET)
            begin += 1 + media[at + 4]
        if not control & 0x10:
            continue
        before, counters[pid] = counters.get(pid), control & 15
        if before is not None and not broken and (before + 1) & 15 != control & 15:
            errors += 1
            if before == control & 15:
                continue  # a packet sent twice
        body = media[begin : at + PACKET]
        if pid in tables:
            data = tables[pid].add(body, start)
            if data and pid == PAT_PID:
                pmt_pid = program_map(data)
                if pmt_pid is not None:
                    tables.setdefault(pmt_pid, Sections())
            elif data and pid == pmt_pid:
                skip = 12 + (int.from_bytes(data[10:12], "big") & 0xFFF)
                if skip + 5 <= len(data) - 4:
                    kind, es_pid = data[skip], int.from_bytes(data[skip + 1 : skip + 3], "big") & 0x1FFF
        elif pid == es_pid:
            if start:
                if body[:3] != b"\0\0\1":
                    raise ValueError("a unit does not begin with a PES packet")
                stamps.append(timestamp_of(body))
                units.append([body[9 + body[8] :]])
            elif units:
                units[-1].append(body)
    if es_pid is None:
        raise ValueError("no program table")
    return {"payload": b"".join(b"".join(u) for u in units), "timestamps": stamps, "random_access": access, "continuity_errors": errors, "packets": len(media) // PACKET, "stream_type": kind}


def encode_batches(batches):
    for batch in batches:
        data = batch.column(1).to_pylist()
        for i in range(0, len(data), 256):
            part = data[i : i + 256]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(part)), pa.array([len(x) for x in part], pa.int64()), pa.array([encode(pad(x)) for x in part], pa.binary())], ["doc_id", "n_bytes", "media"])


def features(media: bytes | None) -> tuple:
    """What a stored stream gives, from the payload's size to the error."""
    size, digest = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
    try:
        x = decode(media or b"")
    except (ValueError, IndexError) as e:
        return None, None, None, size, digest, None, None, None, None, str(e) or "damaged"
    payload, stamps, access = x["payload"], x["timestamps"], x["random_access"]
    ends = f"first={stamps[0]};last={stamps[-1]}" if stamps else "first=;last="
    feature = f"type={x['stream_type']};packets={x['packets']};units={len(stamps)};{ends};access={','.join(map(str, access))};errors={x['continuity_errors']}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), size, digest, feature, stamps, access, x["continuity_errors"], None


def decode_batches(batches):
    for batch in batches:
        rows = [features(media) for media in batch.column(2).to_pylist()]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string())
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access", "continuity_errors", "error"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", *names])


def store_documents(docs: DataFrame) -> DataFrame:
    """Write a transport stream for every row of (doc_id, text) and return the written table: doc_id, n_bytes, media."""
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("data")).mapInArrow(encode_batches, STORED), "media")


def read_documents(stored: DataFrame) -> DataFrame:
    """Payload digests, features, timestamps and random-access points of every stored stream."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(decode_batches, READ)
