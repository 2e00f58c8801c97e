"""Media columns: MPEG audio (operator 7).

:func:`parse` reads a stream: ID3v2/ID3v1 tags, frame headers of MPEG 1, 2 and 2.5
layers I-III with resynchronisation over junk, Xing/Info and VBRI tables, CRC-16
of layer III frames; it gives exact durations (samples over rate) and the byte
offset of every frame. :func:`store` carries a payload losslessly in the
ancillary bytes of silent, CRC-protected layer III frames of variable bit rate.

Defined results: a null text is the empty payload. Payloads are padded with zero
bytes to a positive multiple of 64. Equal texts give equal media and features.
Columns besides doc_id and text are not read. Repeated documents get a row each, no
documents none; a text of any length is one payload, whatever its bytes: sync words or tags in it
lie inside frames, which are walked by their own lengths.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.llm._shared import materialize

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index 1-14, Hz by rate index.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

SIDE = 17  # side info of a mono MPEG 1 layer III frame
LEAD = 4 + 2 + SIDE
#: (bytes for payload, bitrate index) of the frames that store() writes, 48 kHz
ROOM = [(3 * k - LEAD, i) for i, k in enumerate(KBPS[1, 3], 1)]
FULL = ROOM[-1][0]


def _crc_table():
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@lru_cache(4096)
def header(h: bytes):
    """(version, layer, protected, kbps, Hz, bytes, samples, side bytes) of four header bytes, or None."""
    if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 2.5}.get(h[1] >> 3 & 3)
    layer = 4 - (h[1] >> 1 & 3)
    rate, slot = h[2] >> 4, h[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or slot == 3 or h[3] & 3 == 2:
        return None
    kbps, hz, pad = KBPS[1 if version == 1 else 2, layer][rate - 1], HZ[version][slot], h[2] >> 1 & 1
    if layer == 1:
        size, samples = (12000 * kbps // hz + pad) * 4, 384
    else:
        samples = 1152 if layer == 2 or version == 1 else 576
        size = samples // 8 * 1000 * kbps // hz + pad
    mono = h[3] >> 6 == 3
    side = ((17 if mono else 32) if version == 1 else (9 if mono else 17)) if layer == 3 else 0
    return version, layer, not h[1] & 1, kbps, hz, size, samples, side


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[int, dict]:
    """Length of a leading ID3v2 tag and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    end, tags, at = 10 + _unsafe(data[6:10]), {}, 10
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        key, body = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = _unsafe(body) if data[3] == 4 else struct.unpack(">I", body)[0]
        text = data[at + 10 : at + 10 + size]
        if key[0] == "T" and text:
            value = text[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[text[0] & 3], "replace")
            if key == "TXXX":
                key, _, value = value.partition("\0")
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return end, tags


def vbr(data: bytes, at: int, head) -> dict | None:
    """A Xing/Info or VBRI table in the frame at ``at``."""
    x = at + 4 + 2 * head[2] + head[7]
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags = struct.unpack_from(">I", data, x + 4)[0]
        out, x = {"kind": data[x : x + 4].decode()}, x + 8
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key] = struct.unpack_from(">I", data, x)[0]
                x += 4
        if flags & 4:
            out["toc"] = data[x : x + 100]
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        size, frames = struct.unpack_from(">II", data, x + 10)
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return None


def _fills(data: bytes, at: int) -> bool:
    """Whether frames of one kind follow each other from ``at`` to the very end."""
    first = head = header(data[at : at + 4])
    while head and head[:2] == first[:2] and head[4] == first[4]:
        at += head[5]
        if at >= len(data):
            return at == len(data)
        head = header(data[at : at + 4])
    return False


def parse(data: bytes) -> dict:
    """Tags, VBR table, frames (offset, size, start of free bytes), checks, skipped bytes.

    'TAG' 128 bytes before the end opens an ID3v1 tag, unless it lies within frames that fill the stream.
    """
    start, tags = id3v2(data)
    end = len(data) - 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else len(data)
    out = {"tags": tags, "vbr": None, "offsets": [], "sizes": [], "free": [], "crc_ok": 0, "crc_bad": 0, "skipped": 0, "samples": 0, "hz": 0, "kind": ""}
    at, synced = start, False
    while at < end and at + 4 <= len(data):
        head = header(data[at : at + 4])
        after = at + head[5] if head else 0
        if head and end < after <= len(data) and _fills(data, at):
            end = len(data)  # these 'TAG' bytes are a frame's
        # out of step, a header counts only if another of its kind (or the end) follows
        if not head or after > end or not synced and after != end and not (
            (nxt := header(data[after : after + 4])) and nxt[:2] == head[:2] and nxt[4] == head[4]
        ):
            synced = False
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out["skipped"] += to - at
            at = to
            continue
        synced = True
        version, layer, protected, _, hz, size, samples, side = head
        free = at + 4 + 2 * protected + side
        if protected and layer == 3:
            ok = crc16(data[at + 2 : at + 4] + data[at + 6 : free]) == data[at + 4] << 8 | data[at + 5]
            out["crc_ok" if ok else "crc_bad"] += 1
        if not out["offsets"] and out["vbr"] is None and layer == 3 and (table := vbr(data, at, head)):
            out |= {"vbr": table, "hz": hz, "kind": f"mpeg{version}-layer{layer}"}
        else:
            out["offsets"].append(at)
            out["sizes"].append(size)
            out["free"].append(free)
            out["samples"] += samples
            out["hz"] = out["hz"] or hz
            out["kind"] = out["kind"] or f"mpeg{version}-layer{layer}"
        at = after
    out["skipped"] += max(0, end - at)
    return out


@lru_cache(64)
def _lead(index: int) -> bytes:
    h = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return h + struct.pack(">H", crc16(h[2:] + bytes(SIDE))) + bytes(SIDE)


def store(payload: bytes) -> bytes:
    """An MPEG 1 layer III stream (48 kHz, mono, silent) that carries ``payload``."""
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + synchsafe(len(frame)) + frame
    body, full = [], _lead(len(ROOM))
    whole = len(payload) // FULL
    for n in range(whole):
        body += [full, payload[n * FULL : (n + 1) * FULL]]
    if rest := payload[whole * FULL :]:
        room, index = next(x for x in ROOM if x[0] >= len(rest))
        body += [_lead(index), rest, bytes(room - len(rest))]
    audio = b"".join(body)
    frames, first = whole + bool(rest), 168
    total = first + len(audio)
    toc = bytes(min(255, (first + min(frames * p // 100, frames) * 960) * 256 // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    return tag + _lead(4) + xing + bytes(first - LEAD - len(xing)) + audio


def payload_of(data: bytes, parsed: dict) -> bytes:
    raw = b"".join(data[f : o + s] for o, s, f in zip(parsed["offsets"], parsed["sizes"], parsed["free"]))
    return raw[: int(parsed["tags"].get("payload_bytes", len(raw)))]


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def feature(parsed: dict) -> str:
    table = parsed["vbr"] or {}
    seek = zlib.crc32(np.array(parsed["offsets"], "<u8").tobytes())
    return (
        f"{parsed['kind']};hz={parsed['hz']};frames={len(parsed['offsets'])};samples={parsed['samples']}"
        f";us={parsed['samples'] * 1_000_000 // parsed['hz'] if parsed['hz'] else 0}"
        f";vbr={table.get('kind', '-')}:{table.get('frames', 0)}:{table.get('bytes', 0)}"
        f";crc={parsed['crc_ok']}/{parsed['crc_bad']};skipped={parsed['skipped']};seek={seek:08x}"
    )


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every text."""

    def run(batches):
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [store(padded(r)) for r in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


_PROBED = "duration_us long, sample_rate int, n_frames long, frame_offsets array<long>, crc_ok long, crc_bad long, skipped long"


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace a media column by its durations, frame seek offsets and checks."""
    at = media.columns.index(column)
    keep = [f for f in media.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            got = [parse(x or b"") for x in batch.column(at).to_pylist()]
            rest = [c for n, c in enumerate(batch.columns) if n != at]
            cols = [
                pa.array([p["samples"] * 1_000_000 // p["hz"] if p["hz"] else 0 for p in got], pa.int64()),
                pa.array([p["hz"] for p in got], pa.int32()),
                pa.array([len(p["offsets"]) for p in got], pa.int64()),
                pa.array([p["offsets"] for p in got], pa.list_(pa.int64())),
                *[pa.array([p[k] for p in got], pa.int64()) for k in ("crc_ok", "crc_bad", "skipped")],
            ]
            yield pa.RecordBatch.from_arrays(
                [*rest, *cols], [*[f.name for f in keep], "duration_us", "sample_rate", "n_frames", "frame_offsets", "crc_ok", "crc_bad", "skipped"]
            )

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return media.mapInArrow(run, kinds + _PROBED)


def round_trip(docs: DataFrame) -> DataFrame:
    """Store every text as audio in the shared folder, read it back, give the digests."""
    stored = materialize(store_texts(docs), "media")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for media in batch.column("media").to_pylist():
                parsed = parse(media)
                payload = payload_of(media, parsed)
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(parsed))
                )
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return stored.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


