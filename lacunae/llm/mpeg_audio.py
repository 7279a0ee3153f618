"""MPEG audio columns: write bytes into frames, resynchronise, parse tags and tables, verify checksums, index frames.

The writer makes a valid MPEG-1 Layer III stream: an ID3v2 tag with the number of bytes held, a first frame with a Xing table
(frames, bytes, 100 seek points), then mono frames at 44.1 kHz whose side information says that no main data is used (silence),
each with a CRC-16 and 576 payload bytes in its ancillary part. The reader takes any MPEG-1/2/2.5 Layer I-III stream: it skips
tags, finds frame headers that chain to a next header, a tag or the stream's end, resynchronises after damage, verifies checksums of
protected Layer I and III frames (those of Layer II take tables of its bit allocations and aren't verified), reads Xing/Info and
VBRI tables, and gives exact durations (samples over rate) and each frame's place.

Null texts are empty: one frame's payload of bytes 255. Equal texts give equal streams. Repeated rows are each written. Bytes
that hold no frame give no frames and duration 0. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, texts_of

UNIT = 576

#: Fixed values of the format: kbit/s by (MPEG-1?, layer) and index 1 to 14, sampling rates of MPEG-1.
BITRATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 of polynomial 0x8005, most significant bit first, as MPEG audio has it."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_crc = lru_cache(4096)(crc16)


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mono: bool
    bound: int = 32  # Layer I and II: first subband of joint stereo, 32 in other modes

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side_size(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def checked_size(self) -> int:
        """Bytes after the checksum that it covers besides the header's last two: side information, or Layer I's bit allocation."""
        return self.side_size if self.layer == 3 else (16 if self.mono else (32 + self.bound) // 2) if self.layer == 1 else 0


@lru_cache(4096)
def parse_header(four: bytes) -> Header | None:
    """The header, or None if these four bytes are none (or free format, whose length it doesn't tell)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 25}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    return Header(version, layer, not four[1] & 1, BITRATES[version == 1, layer][bitrate - 1], RATES[rate] // {1: 1, 2: 2, 25: 4}[version], four[2] >> 1 & 1, four[3] >> 6 == 3, 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32)


@dataclass
class Stream:
    """What a stream holds."""

    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tag: dict[str, str] = field(default_factory=dict)
    table: dict[str, int] = field(default_factory=dict)
    samples: int = 0
    checked: int = 0
    damaged: int = 0
    resyncs: int = 0

    def seek(self, seconds: float) -> int:
        """Offset of the frame that holds this time."""
        at = 0.0
        for offset, header in zip(self.offsets, self.headers, strict=True):
            at += header.samples / header.rate
            if at > seconds:
                return offset
        return self.offsets[-1] if self.offsets else 0


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def parse_tag(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of an ID3v2.3/2.4 tag at the start, and where the tag ends."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return {}, 0
    number = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at, out = min(len(data), 10 + number(data[6:10])), 10, {}
    while at + 10 <= end and data[at] != 0:
        size = number(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode("utf-8" if body[0] == 3 else "utf-16" if body[0] in (1, 2) else "latin-1", "replace").rstrip("\0")
            if name == "TXXX":  # a described text: its description is part of its name
                described, _, text = text.partition("\0")
                name = f"TXXX:{described}"
            out[name] = text
        at += 10 + size
    return out, end


def parse_table(frame: bytes, header: Header) -> dict[str, int]:
    """Of a Xing/Info or VBRI table in the first frame: frames and bytes, as far as it tells."""
    if frame[36:40] == b"VBRI" and len(frame) >= 54:  # always 32 bytes after the header
        return {"table": 1, "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    at = 4 + 2 * header.protected + header.side_size
    if frame[at : at + 4] not in (b"Xing", b"Info"):
        return {}
    flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"table": 1}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(frame[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["seek_points"] = len(frame[at : at + 100])
    return out


def parse(data: bytes) -> Stream:
    """All frames of a stream. Without sync a header counts if the frame fits and the next bytes are another header, a tag, or the end;
    in sync the frame before has told its place, so it counts if the frame fits.

    The letters TAG 128 bytes before the end begin an ID3v1 tag only if no frame of the chain runs over them. resyncs counts how often
    sync was lost; bytes before the first frame are no loss.
    """
    out = Stream()
    out.tag, at = parse_tag(data)
    end = len(data)
    tail = end - 128 if data[-128:-125] == b"TAG" else end
    synced = False

    def chained(after: int) -> bool:
        return after in (end, tail) or parse_header(data[after : after + 4]) is not None or data[after : after + 3] in (b"TAG", b"ID3") or data[after : after + 8] == b"APETAGEX"

    while at + 4 <= end:
        if at == tail or (not synced and at > tail):
            break
        header = parse_header(data[at : at + 4])
        after = at + header.size if header else 0
        unsure = not synced or at < tail < after < end
        if not header or after > end or (unsure and not chained(after)):
            out.resyncs += synced
            synced, at = False, data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        if header.protected and header.checked_size:
            out.checked += 1
            body = at + 6
            out.damaged += _crc(data[at + 2 : at + 4] + data[body : body + header.checked_size]) != int.from_bytes(data[at + 4 : body], "big")
        table = parse_table(data[at:after], header) if not out.headers and not out.table else {}
        if table:
            out.table = table
        else:
            out.offsets.append(at), out.headers.append(header)
            out.samples += header.samples
        synced, at = True, after
    return out


_SIDE = bytes(17)


def _start(padding: int) -> bytes:
    """Header, checksum and silent side information of a mono frame of MPEG-1 Layer III, 192 kbit/s, 44.1 kHz."""
    head = bytes((0xFF, 0xFA, 11 << 4 | padding << 1, 0xC0))
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


_STARTS = {p: _start(p) for p in (0, 1)}


def paddings(n: int) -> np.ndarray:
    """Which of n frames have a padding byte, so that the mean size is 144 * 192000 / 44100."""
    k = np.arange(n + 1, dtype=np.int64) * 144 * 192000 // 44100
    return np.diff(k) - 626


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The stream that holds payload, a multiple of UNIT bytes."""
    n = len(payload) // UNIT
    pads = paddings(n)
    body = np.zeros((n, 627), np.uint8)
    start = np.stack([np.frombuffer(_STARTS[p], np.uint8) for p in (0, 1)])
    body[:, : start.shape[1]] = start[pads]
    body[:, start.shape[1] : start.shape[1] + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    keep = np.ones((n, 627), bool)
    keep[:, 626] = pads == 1
    frames = body[keep].tobytes()
    ends = np.cumsum(626 + pads)
    toc = bytes(int(256 * (ends[n * k // 100] - 626) // max(1, ends[-1])) & 255 for k in range(100))
    table = (_STARTS[0] + b"Xing" + struct.pack(">III", 7, n, 626 + len(frames)) + toc).ljust(626, b"\0")
    text = b"\3n_bytes\0" + str(n_bytes).encode()
    frame = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + synchsafe(len(frame)) + frame + table + frames


def decode(data: bytes, stream: Stream) -> bytes:
    """The payload held by a stream of encode()."""
    at = np.array(stream.offsets, np.int64) + len(_STARTS[0])
    flat = np.frombuffer(data, np.uint8)
    return flat[at[:, None] + np.arange(UNIT)].tobytes() if len(at) else b""


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media, written to the shared folder and read back."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def make():
        def work(batch):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts_of(batch)]
            return {"doc_id": batch.column("doc_id"), "n_bytes": list(map(len, raw)), "media": [encode(padded(x), len(x)) for x in raw]}

        return work

    kind = base.schema["doc_id"].dataType.simpleString()
    return stored(map_texts(base, ["doc_id", "text"], make, f"doc_id {kind}, n_bytes bigint, media binary"), "mpeg-media")


def read_media(media: DataFrame) -> DataFrame:
    """Of each row (doc_id, media): the payload with its digests, and what parsing the stream gives."""

    def make():
        def work(batch):
            rows = []
            for data in batch.column("media").to_pylist():
                s = parse(data)
                payload = decode(data, s)
                rate = s.headers[0].rate if s.headers else 0
                seek = hashlib.sha256(np.array(s.offsets, "<i8").tobytes()).hexdigest()
                feature = f"frames={len(s.offsets)};table={s.table.get('frames', -1)};bytes={s.table.get('bytes', -1)};samples={s.samples};rate={rate};checked={s.checked};damaged={s.damaged};resyncs={s.resyncs};seek={seek[:16]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, s.samples / rate if rate else 0.0, s.offsets))
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets")
            return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return work

    kind = media.schema["doc_id"].dataType.simpleString()
    return map_texts(media, ["doc_id", "n_bytes", "media"], make, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, seconds double, frame_offsets array<bigint>")


def op8_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    got = read_media(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets")
