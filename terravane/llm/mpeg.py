"""Operator 4: MPEG audio columns.

``encode`` stores bytes as a valid variable-bitrate MPEG-1 Layer III stream of silence: the
payload lies in the ancillary bytes behind each frame's side information, which carries
the frame's checksum. ``parse`` reads any MPEG audio: tags, resynchronised frame headers,
Xing/Info and VBRI tables, CRC-16, exact duration and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import materialize, small_batches, text_of

# Fixed values of ISO/IEC 11172-3 and 13818-3.
_KBPS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_RATE = [44100, 48000, 32000]
_VERSION = {0: 2.5, 2: 2, 3: 1}
_UNIT = 64


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for b in data:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


@lru_cache(4096)
def header(four: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame bytes, samples, sample rate, kbps, protected, side information bytes) of a frame header, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = _VERSION.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbps = _KBPS[1 if version == 1 else 2, layer][index]
    hz = _RATE[rate] >> {1: 0, 2: 1, 2.5: 2}[version]
    pad = four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return size, samples, hz, kbps, not four[1] & 1, side


_SIDE, _FIRST = 17, 4 + 2 + 17
_SIZES = [3 * k for k in _KBPS[1, 3][1:]]  # frame bytes at 48 kHz, by bitrate index - 1


def _head(index: int, protected: bool = True) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC0])


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\x00" + text.encode("latin-1")
    return name + struct.pack(">I", len(body)) + b"\x00\x00" + body


def encode(payload: bytes) -> bytes:
    """The stream that stores the payload: ID3v2, a Xing table, protected mono 48 kHz frames, ID3v1."""
    room = _SIZES[-1] - _FIRST
    full, rest = divmod(len(payload), room)
    lead = _head(14)
    lead += struct.pack(">H", crc16(lead[2:] + bytes(_SIDE))) + bytes(_SIDE)
    body = np.zeros((full, _SIZES[-1]), np.uint8)
    body[:, :_FIRST] = np.frombuffer(lead, np.uint8)
    body[:, _FIRST:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    audio, frames = body.tobytes(), full
    if rest:
        index = next(k for k, s in enumerate(_SIZES, 1) if s - _FIRST >= rest)
        lead = _head(index)
        lead += struct.pack(">H", crc16(lead[2:] + bytes(_SIDE))) + bytes(_SIDE)
        audio += (lead + payload[full * room :]).ljust(_SIZES[index - 1], b"\0")
        frames += 1
    total = len(audio) + _SIZES[4]
    ends = [min(255, 256 * (_SIZES[4] + min(k * frames // 100, full) * _SIZES[-1]) // total) for k in range(100)]
    xing = _head(5, False) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 15, frames, total) + bytes(ends) + struct.pack(">I", 0)
    tags = _text_frame(b"TIT2", "stored bytes") + _text_frame(b"TXXX", f"payload_bytes\0{len(payload)}")
    return b"ID3\x03\x00\x00" + _syncsafe(len(tags)) + tags + xing.ljust(_SIZES[4], b"\0") + audio + b"TAG" + b"stored bytes".ljust(125, b"\0")


def _id3v2(data: bytes, at: int) -> tuple[dict[str, str], int]:
    size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
    end, p, tags = at + 10 + size, at + 10, {}
    major = data[at + 3]
    while major in (3, 4) and p + 10 <= min(end, len(data)) and data[p]:
        raw = data[p + 4 : p + 8]
        n = struct.unpack(">I", raw)[0] if major == 3 else sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0)))
        name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : p + 10 + n]
        if name[:1] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        p += 10 + n
    return tags, end + (10 if data[at + 5] & 0x10 else 0)


def parse(data: bytes) -> dict:
    """tags, table (of the Xing/Info or VBRI header), frames, samples, hz, offsets, sizes, first (byte behind side information), crc_bad, skipped, resyncs.

    Bytes that aren't a header whose successor is a header (or the end, or a tag) are skipped.
    """
    at, end, tags, table = 0, len(data), {}, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        more, at = _id3v2(data, at)
        tags |= more
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    offsets, sizes, first = [], [], []
    samples = hz = bad = skipped = resyncs = 0
    synced = False
    while at < end:
        h = header(data[at : at + 4])
        size = h[0] if h else 0
        if not h or at + size > end or not synced and at + size < end and header(data[at + size : at + size + 4]) is None:
            if synced or not offsets and not skipped:
                resyncs += bool(offsets or at)
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at, synced = nxt, False
            continue
        _, n, rate, _, protected, side = h
        if not offsets and not table and not protected:
            mark = at + 4 + side
            if data[mark : mark + 4] in (b"Xing", b"Info"):
                flags, p = struct.unpack(">I", data[mark + 4 : mark + 8])[0], mark + 8
                table = {"kind": data[mark : mark + 4].decode()}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        table[name], p = struct.unpack(">I", data[p : p + 4])[0], p + 4
                if flags & 4:
                    table["toc"] = list(data[p : p + 100])
            elif data[at + 36 : at + 40] == b"VBRI":
                _, _, _, size_b, frames_b = struct.unpack(">HHHII", data[at + 40 : at + 54])
                table = {"kind": "VBRI", "bytes": size_b, "frames": frames_b}
            if table:
                table["at"], at, synced = at, at + size, True
                continue
        if protected and side:
            bad += struct.unpack(">H", data[at + 4 : at + 6])[0] != crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + side])
        offsets.append(at)
        sizes.append(size)
        first.append(at + 4 + 2 * protected + side)
        samples, hz = samples + n, hz or rate
        at, synced = at + size, True
    return {"tags": tags, "table": table, "frames": len(offsets), "samples": samples, "hz": hz, "offsets": offsets, "sizes": sizes, "first": first, "crc_bad": bad, "skipped": skipped, "resyncs": resyncs}


def decode(data: bytes, info: dict | None = None) -> bytes:
    """The payload of a stream of ``encode``; ValueError if a checksum, the frame count or the length is wrong."""
    info = info or parse(data)
    out = b"".join([data[f : o + s] for f, o, s in zip(info["first"], info["offsets"], info["sizes"])])
    n = int(info["tags"]["payload_bytes"])
    if info["crc_bad"] or info["skipped"] or info["table"].get("frames") != info["frames"] or len(out) < n:
        raise ValueError("damaged stream")
    return out[:n]


def padded(text: bytes) -> bytes:
    return text.ljust(max(_UNIT, -(-len(text) // _UNIT) * _UNIT), b"\0")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [x.as_py() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, media in zip(*batch.columns):
            data = media.as_py()
            info = parse(data)
            back = decode(data, info)
            x = np.frombuffer(back, np.uint8)
            above = x >= 128
            feature = f"frames={info['frames']};samples={info['samples']};hz={info['hz']};sum={int(x.sum(dtype=np.int64))};square={int(np.square(x, dtype=np.int64).sum())};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};max={int(x.max())}"
            rows.append((doc.as_py(), n.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-_UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, info["samples"], info["hz"], info["offsets"]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8 (null: empty), padded with zeros to a positive multiple of 64, as MPEG audio."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored streams hold: payload and media digests, a feature string, exact duration and frame offsets.

    A row per row; a stream whose checksums, table or length are wrong fails the job. Equal streams, equal values.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, seek_offsets array<long>")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media", "zstd")
    return media_features(stored)
