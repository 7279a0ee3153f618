"""Streams whose last frame or real tag has the letters TAG 128 bytes before the end."""

import hashlib
import zlib

import pytest

from lacunae.llm import mpeg_audio as ma


@pytest.mark.parametrize("units", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("at", [475, 476])
def test_text_with_tag_in_its_last_unit(units, at):
    payload = ma.padded(b"x" * ((units - 1) * ma.UNIT + at) + b"TAG and more")
    data = ma.encode(payload, len(payload))
    stream = ma.parse(data)
    assert len(stream.offsets) == units and stream.resyncs == 0
    assert ma.decode(data, stream) == payload
    # damage to an earlier frame loses that frame only, a real tag after the stream is none of it
    if units > 2:
        hurt = bytearray(data)
        hurt[stream.offsets[-2]] = 0
        assert ma.parse(bytes(hurt)).offsets == [*stream.offsets[:-2], stream.offsets[-1]]
    for tagged in (data + b"TAG".ljust(128, b"\xff"), data[:-50] + b"TAG".ljust(128, b"\0")):
        got = ma.parse(tagged).offsets
        assert got == (stream.offsets if len(tagged) > len(data) + 100 else stream.offsets[:-1])


def test_media_with_tag(spark):
    texts = {k: "y" * (576 * (k // 2) + 475 + k % 2) + "TAG" + "z" * 40 for k in range(8)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = set()
    for k, t in texts.items():
        p = ma.padded(t.encode())
        want.add((k, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert {(r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in ma.read_media(ma.write_media(docs)).collect()} == want


def test_false_header_in_leading_garbage():
    payload = ma.padded(b"text " * 400)
    data = ma.encode(payload, 2000)
    start = ma.parse(data)
    garbage = bytes((0xFF, 0xFA, 11 << 4, 0xC0)) + bytes(50)
    body = data[data.index(b"\xff\xfa", 10) :]
    got = ma.parse(garbage + body)
    assert got.table == start.table and got.resyncs == 0
    assert ma.decode(garbage + body, got) == payload
    assert ma.parse(garbage).offsets == [] and ma.parse(garbage * 3).offsets == []


def test_tag_tells_the_bytes_held():
    stream = ma.parse(ma.encode(ma.padded(b"abc"), 3))
    assert stream.tag == {"TXXX:n_bytes": "3"}


def test_vbri_table():
    frame = bytearray(ma._start(0).ljust(626, b"\0"))
    frame[36:40], frame[46:50], frame[50:54] = b"VBRI", (5000).to_bytes(4, "big"), (7).to_bytes(4, "big")
    stream = ma.parse(bytes(frame) + ma._start(0).ljust(626, b"\0") * 2)
    assert stream.table == {"table": 1, "bytes": 5000, "frames": 7} and len(stream.offsets) == 2


def test_checksums_of_layer_one():
    head = bytes((0xFF, 0xFE, 4 << 4, 0x40))  # MPEG-1 Layer I, protected, 128 kbit/s, 44.1 kHz, joint stereo
    header = ma.parse_header(head)
    assert (header.layer, header.bound, header.checked_size) == (1, 4, 18)
    body = bytes(range(18))
    good = head + ma.crc16(head[2:] + body).to_bytes(2, "big") + body
    frame = good.ljust(header.size, b"\0")
    bad = bytearray(frame)
    bad[10] ^= 1
    stream = ma.parse(frame + bytes(bad) + frame)
    assert (stream.checked, stream.damaged, stream.samples) == (3, 1, 3 * 384)
