"""MPEG audio columns: write payloads as frames, and parse frame streams.

The reader resynchronises on frame headers (a header counts when the next one follows where its length
says, or the stream ends there), skips ID3 tags, reads Xing/Info/VBRI tables, verifies the CRC of
protected frames of layers I and III, and gives exact durations in samples and the byte offset of every frame. The CRC of
layer II covers bits whose number depends on the allocation; such frames are counted as unchecked.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.llm.common import map_arrow

# Fixed values of the MPEG audio standard: kbit/s by (MPEG-1 or later, layer), samples per second by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

PAD = 64
_SIDE = 17  # side information of a mono MPEG-1 layer III frame


@dataclass
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    side: int
    covered: int  # bytes behind the checksum that it covers; 0 if they are not known


@lru_cache(4096)
def parse_header(raw: bytes) -> Header | None:
    """The frame header in four bytes, or None. Free-format frames are not taken for frames."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3)
    layer = 4 - (raw[1] >> 1 & 3)
    rate_at, kbps_at, padding = raw[2] >> 2 & 3, raw[2] >> 4, raw[2] >> 1 & 1
    if version is None or layer == 4 or rate_at == 3 or kbps_at in (0, 15):
        return None
    kbps, rate = BITRATES[min(int(version), 2), layer][kbps_at], RATES[version][rate_at]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + padding
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    joint = 4 * (raw[3] >> 4 & 3) + 4 if raw[3] >> 6 == 1 else 32  # subbands that a layer I frame codes for each channel
    covered = side if layer == 3 else 16 if layer == 1 and mono else (joint * 8 + (32 - joint) * 4) // 8 if layer == 1 else 0
    return Header(version, layer, not raw[1] & 1, kbps, rate, length, samples, side, covered)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The standard's CRC: polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Audio:
    """What a stream holds. main: the layer III main data regions of its audio frames, joined."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    version: float | None = None
    layer: int | None = None
    rate: int | None = None
    samples: int = 0
    seconds: float = 0.0
    offsets: list[int] = field(default_factory=list)
    resyncs: int = 0
    bad_crc: int = 0
    unchecked_crc: int = 0
    main: bytes = b""


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of a leading ID3v2 tag and its text frames (user texts as TXXX:name)."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size, at, tags = min(len(data), 10 + _syncsafe(data[6:10])), 10, {}
    while at + 10 <= size and data[at : at + 1].isalnum():
        name = data[at : at + 4].decode("latin-1")
        n = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + n]
        if name.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            if name == "TXXX":
                key, _, text = text.partition("\0")
                name = f"TXXX:{key}"
            tags[name] = text.rstrip("\0")
        at += 10 + n
    return size, tags


def _vbr_table(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, out = int.from_bytes(frame[at + 4 : at + 8], "big"), {"kind": frame[at : at + 4].decode()}
        at += 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[at : at + 4], "big")
                at += 4
        if flags & 4:
            out["toc"] = frame[at : at + 100]
        return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return None


def read_audio(data: bytes) -> Audio:
    """Parse a stream of frames; bytes that are no frame are skipped and counted as resyncs."""
    out = Audio()
    at, out.tags = _id3v2(data)
    end = len(data)
    id3v1 = end - 128 if end >= 128 and data[end - 128 : end - 125] == b"TAG" else end  # unless these bytes lie in a frame
    main, synced, first = [], True, True
    while at + 4 <= end and at != id3v1:
        h = parse_header(data[at : at + 4])
        ok = h is not None and at + h.length <= end
        if ok and (not synced or at < id3v1 < at + h.length):  # only where another header or the end follows
            after = at + h.length
            ok = after in (id3v1, end) or parse_header(data[after : after + 4]) is not None
        if not ok:
            if synced:
                out.resyncs += 1
                synced = False
            at = data.find(b"\xff", at + 1, id3v1)
            if at < 0:
                break
            continue
        synced = True
        frame = data[at : at + h.length]
        if first:
            first = False
            out.version, out.layer, out.rate = h.version, h.layer, h.rate
            out.vbr = _vbr_table(frame, h)
            if out.vbr:
                at += h.length
                continue
        body = 4
        if h.protected:
            body = 6
            if not h.covered:
                out.unchecked_crc += 1
            elif crc16(frame[2:4] + frame[6 : 6 + h.covered]) != int.from_bytes(frame[4:6], "big"):
                out.bad_crc += 1
        out.offsets.append(at)
        out.samples += h.samples
        out.seconds += h.samples / h.rate
        main.append(frame[body + h.side :])
        at += h.length
    if at <= id3v1 < end:
        out.tags.setdefault("TIT2", data[id3v1 + 3 : id3v1 + 33].split(b"\0")[0].decode("latin-1"))
    out.main = b"".join(main)
    return out


def _frame(kbps_at: int, protected: bool, body: bytes, side: bytes = bytes(_SIDE)) -> bytes:
    head = bytes((0xFF, 0xFA if protected else 0xFB, kbps_at << 4 | 1 << 2, 0xC0))
    crc = crc16(head[2:4] + side).to_bytes(2, "big") if protected else b""
    frame = head + crc + side + body
    return frame.ljust(parse_header(head).length, b"\0")


_ROOM = {k: 3 * kbps - 6 - _SIDE for k, kbps in enumerate(BITRATES[1, 3]) if kbps}  # 48 kHz: three bytes for each kbit/s


def write_audio(payload: bytes, n_bytes: int) -> bytes:
    """A variable-bitrate mono stream (48 kHz, CRC on) whose main data is the payload; n_bytes goes to a tag."""
    room = _ROOM[14]
    frames = [_frame(14, True, payload[i : i + room]) for i in range(0, len(payload) - room + 1, room)]
    if rest := len(payload) % room:
        k = next(k for k, r in sorted(_ROOM.items()) if r >= rest)
        frames.append(_frame(k, True, payload[len(payload) - rest :]))
    total, sums = sum(map(len, frames)), np.cumsum([0, *map(len, frames)])
    toc = bytes(min(255, int(sums[len(frames) * i // 100]) * 256 // total) for i in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + (total + 192).to_bytes(4, "big") + toc
    text = b"".join(b"TXXX" + len(t).to_bytes(4, "big") + b"\0\0" + t for t in (b"\0payload\0%d" % len(payload), b"\0source\0%d" % n_bytes))
    size = len(text)
    tag = b"ID3\4\0\0" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + text
    return tag + _frame(5, False, xing) + b"".join(frames)


def payload_of(text: bytes) -> bytes:
    """The bytes, zero-filled to a positive multiple of 64."""
    return text.ljust(max(PAD, -(-len(text) // PAD) * PAD), b"\0")


def feature_of(a: Audio) -> str:
    """version/layer/rate:frames:samples:resyncs:bad checksums:CRC of the seek offsets."""
    offsets = zlib.crc32(np.array(a.offsets, "<u8").tobytes())
    return f"{a.version}/{a.layer}/{a.rate}:{len(a.offsets)}:{a.samples}:{a.resyncs}:{a.bad_crc}:{offsets:08x}"


def _encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or b"" for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write_audio(payload_of(t), len(t)) for t in texts], pa.binary())], ["doc_id", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: each text's UTF-8 bytes (null: none), padded, as an MPEG stream."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), _encode_rows, "doc_id long, media binary")


AUDIO_SCHEMA = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, frames long, samples long, seconds double, seek_offsets array<long>, bad_crc long, unchecked_crc long, resyncs long, vbr_kind string, vbr_frames long, vbr_bytes long, tags map<string,string>, feature string"


def _parse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("frames", pa.int64()), ("samples", pa.int64()), ("seconds", pa.float64()), ("seek_offsets", pa.list_(pa.int64())), ("bad_crc", pa.int64()), ("unchecked_crc", pa.int64()), ("resyncs", pa.int64()), ("vbr_kind", pa.string()), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("feature", pa.string())])
    for b in batches:
        rows = []
        for doc, media in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if media is None:
                rows.append((doc, *[None] * (len(schema) - 1)))
                continue
            a = read_audio(media)
            payload = a.main[: int(a.tags.get("TXXX:payload", len(a.main)))]
            n = a.tags.get("TXXX:source")
            rows.append((doc, int(n) if n else None, payload, len(media), hashlib.sha256(media).hexdigest(), len(a.offsets), a.samples, a.seconds, a.offsets, a.bad_crc, a.unchecked_crc, a.resyncs, *((a.vbr or {}).get(k) for k in ("kind", "frames", "bytes")), list(a.tags.items()), feature_of(a)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def parse_audio(media: DataFrame) -> DataFrame:
    """Durations, seek offsets, checksums, tags and payload of each stream in `media` (doc_id, media).

    A null stream gives nulls; bytes without any frame give zero frames. Repeated rows are each parsed;
    extra columns are ignored.
    """
    return map_arrow(media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")), _parse_rows, AUDIO_SCHEMA)


def digests(parsed: DataFrame) -> DataFrame:
    """The parsed streams with digests in place of payload and tables."""
    return parsed.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 63, 1), 64)")).alias("tail_crc32"),  # right() counts characters
        "media_bytes",
        "media_sha256",
        "feature",
    )
