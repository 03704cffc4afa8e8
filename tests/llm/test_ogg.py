import hashlib
import zlib

import pytest

from shelfmark.llm.ogg import CONTINUED, OggError, _pages_of, checksum, demultiplex, media_features, padded, read_pages, read_payload, store_media, write_payload


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_containers():
    for data in (b"", b"\0", b"OggS", bytes(range(256)) * 3):
        assert checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1152, 60_000, 200_001])
def test_round_trip_and_structure(size):
    text = bytes(k * 7 % 251 for k in range(size))
    payload = padded(text)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[:size] == text and set(payload[size:]) <= {255}
    data = write_payload(payload)
    assert read_payload(data) == (payload, len(payload) // 576, len(payload) / 8000)
    streams = demultiplex(data)
    assert sorted(streams) == [1, 2]
    assert [end for end, _ in streams[1][1:]] == [576 * k for k in range(1, len(streams[1]))]


def test_packets_run_over_page_ends():
    packets = [bytes([k]) * 1000 for k in range(200)]
    data = b"".join(page for _, page in _pages_of(9, b"head", packets, 1000))
    assert any(flags & CONTINUED for flags, *_ in read_pages(data))
    assert demultiplex(data) == {9: [(-1, b"head"), *((1000 * k + 1000, x) for k, x in enumerate(packets))]}


def test_damage_is_found():
    data = write_payload(padded(b"x" * 5000))
    for at in range(0, len(data), 97):
        with pytest.raises(OggError):
            read_payload(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(OggError):
        read_payload(data[:-1])


def test_columns(spark, documents):
    rows = [(1, "abc", "en"), (2, None, "en"), (3, "", None), (3, "", None), (4, "é" * 400_000, "fr"), (5, "abc", "de")]
    out = media_features(store_media(documents(rows))).collect()
    assert len(out) == 6
    for r in out:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        payload = padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes > r.payload_bytes and r.error is None
    by = {r.doc_id: r for r in out}
    assert by[1][3:] == by[5][3:] and by[2][3:] == by[3][3:]
    assert media_features(store_media(documents([]))).count() == 0
    broken = spark.createDataFrame([(1, 2, b"OggS broken"), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [bool(r.error) for r in media_features(broken).orderBy("doc_id").collect()] == [True, True]
