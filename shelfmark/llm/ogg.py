"""Media columns in an Ogg container: pages with checksums, packets from lacing values, two multiplexed logical streams.

A payload is cut into frames of 576 samples of 8 bits.  Even frames are packets of stream 1, odd frames of stream 2, each after a
header packet on a page of its own.  A page's granule position is the number of the stream's samples that end on it; the reader
derives every packet's time from it and merges the streams by time.

Defined results: a null payload counts as empty; the padding makes at least one frame; a stored form with a broken page raises
``OggError`` in :func:`read_pages` and gives an `error` text with null features in the column form.  Nothing depends on row order.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 576
STREAMS = 2
RATE = 8000
MAGIC = b"PCM8"
CONTINUED, FIRST, LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = "<4sBBqIIIB"


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, high bit first, start 0.  zlib has it low bit first; mirroring bits converts."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def _pages_of(serial: int, header: bytes, packets: list[bytes], unit: int) -> list[tuple[int, bytes]]:
    """(time in samples, page) of one logical stream; packets run on over page ends."""
    pages = [(-1, _page(FIRST | (0 if packets else LAST), 0, serial, 0, bytes([len(header)]), header))]
    segments: list[tuple[int, bytes, bool]] = []
    for packet in packets:
        whole, rest = divmod(len(packet), 255)
        for k in range(whole):
            segments.append((255, packet[k * 255 : k * 255 + 255], False))
        segments.append((rest, packet[whole * 255 :], True))
    done = inside = 0
    for first in range(0, len(segments), 255):
        part = segments[first : first + 255]
        closed = sum(end for _, _, end in part)
        begun, done = done, done + closed
        flags = (CONTINUED if inside else 0) | (LAST if first + 255 >= len(segments) else 0)
        body = b"".join(x for _, x, _ in part)
        granule = done * unit if closed else -1
        pages.append((begun * unit, _page(flags, granule, serial, len(pages), bytes(size for size, _, _ in part), body)))
        inside = not part[-1][2]
    return pages


def write_payload(payload: bytes) -> bytes:
    """A physical stream: header pages first, then the pages of all streams in time order."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    pages = []
    for s in range(STREAMS):
        header = MAGIC + struct.pack("<BBHI", s, STREAMS, FRAME, RATE)
        pages += _pages_of(s + 1, header, frames[s::STREAMS], FRAME)
    return b"".join(page for _, page in sorted(pages, key=lambda x: x[0]))


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page, checksum verified."""
    at = 0
    while at < len(data):
        if len(data) < at + 27:
            raise OggError("cut page")
        magic, version, flags, granule, serial, number, crc, count = struct.unpack_from(_HEAD, data, at)
        if magic != b"OggS" or version:
            raise OggError("no page start")
        lacing = data[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > len(data):
            raise OggError("cut page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("checksum")
        yield flags, granule, serial, number, lacing, data[at + 27 + count : end]
        at = end


def demultiplex(data: bytes) -> dict[int, list[tuple[int, bytes]]]:
    """Per logical stream its packets, each with the granule position at which it ends (-1 for headers)."""
    streams: dict[int, list[tuple[int, bytes]]] = {}
    open_parts: dict[int, list[bytes]] = {}
    numbers: dict[int, int] = {}
    for flags, granule, serial, number, lacing, body in read_pages(data):
        if number != numbers.get(serial, 0) or bool(flags & FIRST) != (serial not in numbers):
            raise OggError("page order")
        if bool(flags & CONTINUED) != bool(open_parts.get(serial)):
            raise OggError("broken packet")
        numbers[serial] = number + 1
        packets, parts, at = [], open_parts.pop(serial, []), 0
        for size in lacing:
            parts.append(body[at : at + size])
            at += size
            if size < 255:
                packets.append(b"".join(parts))
                parts = []
        if parts:
            open_parts[serial] = parts
        ends, now = [], granule
        for packet in reversed(packets):  # the page's position is the end of its last packet; earlier ones count back
            ends.append(now if number else -1)
            now -= len(packet)
        streams.setdefault(serial, []).extend(zip(reversed(ends), packets, strict=True))
    if any(open_parts.values()):
        raise OggError("unfinished packet")
    return streams


def read_payload(data: bytes) -> tuple[bytes, int, float]:
    """(payload, packets, seconds) from the stored bytes."""
    timed = []
    if not data:
        raise OggError("empty")
    for packets in demultiplex(data).values():
        if not packets or packets[0][1][:4] != MAGIC:
            raise OggError("unknown codec")
        index, count, frame, rate = struct.unpack("<BBHI", packets[0][1][4:])
        for end, packet in packets[1:]:
            timed.append((((end - len(packet)) // frame * count + index) * frame, packet))
    timed.sort(key=lambda x: x[0])
    payload = b"".join(x for _, x in timed)
    if [t for t, _ in timed] != list(range(0, len(payload), FRAME)):
        raise OggError("gap in time")
    return payload, len(timed), len(payload) / RATE


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def features(payload: bytes, packets: int, seconds: float, pages: int) -> str:
    samples = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    total, square = int(samples.sum()), int((samples * samples).sum())
    crossings = int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0)))
    return f"packets={packets};pages={pages};ms={round(seconds * 1000)};sum={total};energy={square};crossings={crossings}"


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, error string"
)


def store_media(frame: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary): each text as an Ogg file."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            texts = [x or b"" for x in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([write_payload(padded(x)) for x in texts], pa.binary())],
                ["doc_id", "n_bytes", "media"])

    return frame.select("doc_id", F.col(text).cast("binary").alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads stored media back and describes it; a broken file gets its reason in `error`."""

    def describe(data: bytes | None):
        data = data or b""
        try:
            payload, packets, seconds = read_payload(data)
        except OggError as broken:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, str(broken)
        found = features(payload, packets, seconds, sum(1 for _ in read_pages(data)))
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
                hashlib.sha256(data).hexdigest(), found, None)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def run(batches):
        for batch in batches:
            rows = [describe(x) for x in batch.column(2).to_pylist()]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)
