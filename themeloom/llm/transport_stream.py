"""Media columns as MPEG transport streams: written, stored, read back and described.

A payload becomes one elementary stream of 8-bit samples in packets of 188 bytes: program tables
(association and map) before every ``RANDOM_EVERY``-th unit, which is also a random-access point
with a clock reference; each unit is one elementary packet with a presentation time.  Reading
parses the tables with their checksums, follows the continuity counters of every stream, joins the
payloads of the elementary stream, and takes its packets apart again; it gives the samples, the
timestamps, the random-access points and the number of breaks.

Defined results: null texts count as empty, and an empty text is stored as 64 zero bytes; equal
texts give equal streams and values; repeated rows are stored row by row; an empty table gives an
empty result; only doc_id and text are read.  In a damaged stream, tables with a wrong checksum and
units without a start code are left out, and every jump of a counter counts as a break.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themeloom.llm.scan import text_bytes
from themeloom.llm.tables import documents, keyed_texts, query, slices
from themeloom.session import run_folder

PACKET = 188
ROOM = 184  # of a packet after its header
SYNC = 0x47
TABLE_PID, MAP_PID, DATA_PID = 0x0000, 0x0100, 0x0101
PRIVATE_DATA, STREAM_ID = 0x06, 0xBD
UNIT_PACKETS = 12
HEADER = 14  # of an elementary packet with one timestamp
CLOCK_FIELD = 8  # adaptation field with a clock reference
# Samples of a unit: it fills its packets exactly.
UNIT = UNIT_PACKETS * ROOM - CLOCK_FIELD - HEADER
RANDOM_EVERY = 8
TICKS = 10  # of the 90 kHz clock, for each sample at 9 kHz
TIME_BITS = 33
BLOCK = 64


def _crc_table() -> list[int]:
    table = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def table_checksum(data: bytes) -> int:
    """CRC-32 of program tables; 0 over a table with its checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(kind: int, ident: int, body: bytes) -> bytes:
    head = bytes([kind]) + (0xB000 | len(body) + 9).to_bytes(2, "big")
    data = head + ident.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return data + table_checksum(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), dtype=np.uint8)


_TABLES = np.stack([
    _table_packet(TABLE_PID, _section(0, 1, b"\0\1" + (0xE000 | MAP_PID).to_bytes(2, "big"))),
    _table_packet(MAP_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0"
                                    + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big")
                                    + b"\xf0\0")),
])


def _times(first: np.ndarray) -> np.ndarray:
    """The five bytes of a presentation time, for each unit that begins at a sample."""
    t = first.astype(np.int64) * TICKS % (1 << TIME_BITS)
    return np.stack([0x21 | t >> 29 & 0x0E, t >> 22 & 0xFF, 0x01 | t >> 14 & 0xFE, t >> 7 & 0xFF,
                     0x01 | t << 1 & 0xFE], axis=1).astype(np.uint8)


def _clocks(first: np.ndarray) -> np.ndarray:
    """The six bytes of a clock reference."""
    t = first.astype(np.int64) * TICKS % (1 << TIME_BITS)
    return np.stack([t >> 25 & 0xFF, t >> 17 & 0xFF, t >> 9 & 0xFF, t >> 1 & 0xFF,
                     (t & 1) << 7 | 0x7E, t * 0], axis=1).astype(np.uint8)


def _heads(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Headers of elementary packets that hold ``size`` samples from sample ``first`` on."""
    n = len(size)
    head = np.zeros((n, HEADER), dtype=np.uint8)
    head[:, :4] = [0, 0, 1, STREAM_ID]
    length = size + HEADER - 6
    head[:, 4], head[:, 5] = length >> 8, length & 255
    head[:, 6:9] = [0x84, 0x80, 5]
    head[:, 9:] = _times(first)
    return head


def write_stream(payload: np.ndarray) -> np.ndarray:
    """A transport stream of 8-bit samples (at least one)."""
    n = len(payload)
    full, rest = divmod(n, UNIT)
    parts = []
    if full:
        first = np.arange(full) * UNIT
        units = np.zeros((full, UNIT_PACKETS, PACKET), dtype=np.uint8)
        units[:, :, 0] = SYNC
        units[:, :, 1], units[:, :, 2] = DATA_PID >> 8, DATA_PID & 255
        units[:, 0, 1] |= 0x40
        units[:, :, 3] = 0x10
        units[:, 0, 3] = 0x30
        units[:, 0, 4], units[:, 0, 5] = CLOCK_FIELD - 1, 0x10
        units[::RANDOM_EVERY, 0, 5] |= 0x40
        units[:, 0, 6:12] = _clocks(first)
        body = np.concatenate([_heads(np.full(full, UNIT), first),
                               payload[:full * UNIT].reshape(full, UNIT)], axis=1)
        units[:, 0, 4 + CLOCK_FIELD:] = body[:, :ROOM - CLOCK_FIELD]
        units[:, 1:, 4:] = body[:, ROOM - CLOCK_FIELD:].reshape(full, UNIT_PACKETS - 1, ROOM)
        parts.append(units.reshape(-1, PACKET))
    if rest:
        first = np.array([full * UNIT])
        body = np.concatenate([_heads(np.array([rest]), first)[0], payload[full * UNIT:]])
        count = -(-(len(body) + CLOCK_FIELD) // ROOM)
        last = np.full((count, PACKET), 0xFF, dtype=np.uint8)
        last[:, 0], last[:, 1], last[:, 2], last[:, 3] = SYNC, DATA_PID >> 8, DATA_PID & 255, 0x10
        last[0, 1] |= 0x40
        last[0, 3] = 0x30
        last[0, 4], last[0, 5] = CLOCK_FIELD - 1, 0x10 | (0x40 if full % RANDOM_EVERY == 0 else 0)
        last[0, 6:12] = _clocks(first)[0]
        spare = count * ROOM - CLOCK_FIELD - len(body)
        begin = np.full(count, 4)
        begin[0] += CLOCK_FIELD
        if spare:  # stuffing: a longer adaptation field in the last packet
            if count > 1:
                last[-1, 3] = 0x30
                last[-1, 4] = spare - 1
                if spare > 1:
                    last[-1, 5] = 0
                begin[-1] += spare
            else:
                last[0, 4] += spare
                begin[0] += spare
        last[np.arange(PACKET) >= begin[:, None]] = body
        parts.append(last)
    data = np.concatenate(parts)
    units = full + bool(rest)
    points = np.arange(0, units, RANDOM_EVERY)
    where = points * UNIT_PACKETS  # packets before each random-access point
    stream = np.insert(data, np.repeat(where, 2), np.tile(_TABLES, (len(points), 1)), axis=0)
    at = where + 2 * np.arange(len(points))
    table = np.zeros(len(stream), dtype=bool)
    table[at] = table[at + 1] = True
    stream[at, 3] |= (np.arange(len(points)) & 15).astype(np.uint8)
    stream[at + 1, 3] |= (np.arange(len(points)) & 15).astype(np.uint8)
    stream[~table, 3] |= (np.arange(len(data)) & 15).astype(np.uint8)
    return stream.reshape(-1)


class Parsed(NamedTuple):
    samples: np.ndarray
    times: np.ndarray  # of each unit, in ticks of 90 kHz
    sizes: np.ndarray  # samples of each unit
    random: np.ndarray  # whether a unit is a random-access point
    breaks: int  # jumps of continuity counters
    packets: int


def _sections(packets: np.ndarray, kind: int) -> list[bytes]:
    """Bodies of the program tables that begin in the given packets, if their checksum holds."""
    out = []
    for data in dict.fromkeys(row.tobytes() for row in packets[:, 4:]):
        data = data[1 + data[0]:]
        size = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
        if data[:1] == bytes([kind]) and not table_checksum(data[:size]):
            out.append(data[8:size - 4])
    return out


def read_stream(media: np.ndarray) -> Parsed:
    """The samples of the first program's first stream, and what the stream says about them."""
    packets = media[:len(media) // PACKET * PACKET].reshape(-1, PACKET)
    packets = packets[packets[:, 0] == SYNC]
    head = packets[:, :4].astype(np.int64)
    pid = (head[:, 1] & 0x1F) << 8 | head[:, 2]
    begins = head[:, 1] & 0x40 > 0
    field, filled = head[:, 3] & 0x20 > 0, head[:, 3] & 0x10 > 0
    counter = head[:, 3] & 15
    breaks = 0
    for p in np.unique(pid):
        own = counter[(pid == p) & filled]
        breaks += int(np.count_nonzero((own[1:] - own[:-1] - 1) & 15))
    programs = [int.from_bytes(body[i + 2:i + 4], "big") & 0x1FFF
                for body in _sections(packets[(pid == TABLE_PID) & begins], 0)
                for i in range(0, len(body), 4) if body[i:i + 2] != b"\0\0"]
    streams = [int.from_bytes(body[4 + skip + 1:4 + skip + 3], "big") & 0x1FFF
               for p in programs[:1] for body in _sections(packets[(pid == p) & begins], 2)
               for skip in [int.from_bytes(body[2:4], "big") & 0x0FFF]]
    none = np.zeros(0, dtype=np.int64)
    if not streams:
        return Parsed(media[:0], none, none, none.astype(bool), breaks, len(packets))
    own = np.flatnonzero((pid == streams[0]) & filled)
    rows = packets[own]
    begin = 4 + np.where(field[own], 1 + rows[:, 4].astype(np.int64), 0)
    begin = np.minimum(begin, PACKET)
    data = rows[np.arange(PACKET) >= begin[:, None]]
    sizes = PACKET - begin
    offset = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(begins[own])
    start = offset[heads]
    end = np.append(start[1:], len(data))
    whole = end - start >= HEADER
    heads, start, end = heads[whole], start[whole], end[whole]
    lead = data[start[:, None] + np.arange(HEADER)].astype(np.int64)
    right = (lead[:, 0] == 0) & (lead[:, 1] == 0) & (lead[:, 2] == 1) & (lead[:, 7] & 0x80 > 0)
    heads, start, end, lead = heads[right], start[right], end[right], lead[right]
    times = ((lead[:, 9] & 0x0E) << 29 | lead[:, 10] << 22 | (lead[:, 11] & 0xFE) << 14
             | lead[:, 12] << 7 | lead[:, 13] >> 1)
    random = field[own[heads]] & (rows[heads, 4] > 0) & (rows[heads, 5] & 0x40 > 0)
    first = start + 9 + lead[:, 8]
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(inside, first, 1)
    np.add.at(inside, end, -1)
    samples = data[np.cumsum(inside[:-1]) > 0]
    return Parsed(samples, times, end - first, random, breaks, len(packets))


def padded(raw: bytes) -> bytes:
    """Bytes with zeros up to a positive multiple of ``BLOCK``."""
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, times, random): a transport stream of every text.

    ``times`` are the presentation times of its units, ``random`` the numbers of those where
    reading can begin.
    """
    def mux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                data, offsets = text_bytes(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                media, times, random = [], [], []
                for a, b in zip(at, at[1:], strict=False):
                    payload = np.frombuffer(padded(raw[a:b]), dtype=np.uint8)
                    units = -(-len(payload) // UNIT)
                    media.append(write_stream(payload).tobytes())
                    times.append(np.arange(units) * UNIT * TICKS % (1 << TIME_BITS))
                    random.append(np.arange(0, units, RANDOM_EVERY))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media),
                     pa.array(times, pa.list_(pa.int64())), pa.array(random, pa.list_(pa.int64()))],
                    names=["doc_id", "n_bytes", "media", "times", "random"])

    return keyed_texts(docs).mapInArrow(
        mux, "doc_id long, n_bytes long, media binary, times array<long>, random array<long>")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and a description of each stored stream, from its bytes.

    The description names units, random-access points, breaks, the last time, whether the times
    are those stored beside the stream, and mean and spread of the samples.
    """
    def demux(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for blob, times, random in zip(batch.column("media"), batch.column("times"),
                                           batch.column("random"), strict=True):
                stored = np.frombuffer(blob.as_buffer(), dtype=np.uint8)
                got = read_stream(stored)
                samples = got.samples.tobytes()
                same = (np.array_equal(got.times, times.values.to_numpy())
                        and np.array_equal(np.flatnonzero(got.random), random.values.to_numpy()))
                x = got.samples
                total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
                n = max(len(x), 1)
                mean = total / n
                row = (len(samples), hashlib.sha256(samples).hexdigest(),
                       zlib.crc32(samples[-BLOCK:]), len(stored),
                       hashlib.sha256(stored).hexdigest(),
                       f"units={len(got.times)};random={int(got.random.sum())};"
                       f"breaks={got.breaks};packets={got.packets};"
                       f"last={int(got.times[-1]) if len(got.times) else -1};"
                       f"indexed={int(same)};mean={mean:.4f};"
                       f"spread={max(square / n - mean * mean, 0) ** 0.5:.4f}")
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"),
                 *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
                       "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(
        demux, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, "
               "tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store(media: DataFrame) -> DataFrame:
    """``media`` written as a compressed table in the shared folder, to be read from there."""
    import uuid

    spark = media.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


@query
def op5_transport_stream(spark, sf_dir):
    """Every document as a stored transport stream, read back and described."""
    return media_features(store(media_table(documents(spark, sf_dir))))
