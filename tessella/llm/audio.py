"""MPEG audio columns: build, resynchronise, verify and index streams of MPEG-1/2/2.5 layers I to III.

``encode_audio`` stores a payload losslessly as a playable stream: an ID3v2.4 tag, a variable-bitrate table
frame, then silent CRC-protected mono layer III frames whose ancillary data (the bytes a decoder skips behind
an empty granule) are the payload. ``probe_audio`` reads any stream: tags at both ends, Xing/Info/VBRI tables,
frame headers with resynchronisation over junk, checksums, exact duration and the byte offset of each frame.

Defined results: a null text is the empty text; an empty or unparsable stream has 0 frames, 0 samples and no
offsets; bytes that belong to no frame count as ``skipped``; a frame cut off by the end is not a frame.
Inputs keep nothing but the named columns, so extra columns can't clash. Equal streams give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import text_or_empty
from tessella.session import ship_package

_KBPS = {
    (3, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (3, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 3): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_VERSION = {3: "1", 2: "2", 0: "2.5"}
_LAYER = {3: 1, 2: 2, 1: 3}

#: Widths of the layer II allocation fields: (width, how many subbands) runs by table.
_ALLOC = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "lsf": ((4, 4), (3, 7), (2, 19)),
}


def _crc_table() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return tuple(out)


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes, bits: int) -> int:
    """The MPEG audio checksum over the first ``bits`` bits."""
    crc = 0xFFFF
    for b in data[: bits >> 3]:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ b]
    for i in range(bits & 7):
        bit = (data[bits >> 3] >> (7 - i)) & 1
        crc = ((crc << 1) & 0xFFFF) ^ (0x8005 if (crc >> 15) ^ bit else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    mode: int
    mode_ext: int

    @property
    def samples(self) -> int:
        return 384 if self.layer == 3 else 576 if self.layer == 1 and self.version != 3 else 1152

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side_bytes(self) -> int:
        """Layer III side information."""
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)

    def length(self, kbps: int | None = None) -> int:
        bits = (self.kbps if kbps is None else kbps) * 1000
        if self.layer == 3:
            return (12 * bits // self.rate + self.padding) * 4
        return (72 if self.samples == 576 else 144) * bits // self.rate + self.padding

    def kin(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=65536)
def parse_header(word: int) -> Header | None:
    """The header in a 32-bit word; None if it can't be one."""
    version, layer = (word >> 19) & 3, (word >> 17) & 3
    index, rate = (word >> 12) & 15, (word >> 10) & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 0 or index == 15 or rate == 3 or word & 3 == 2:
        return None
    mode = (word >> 6) & 3
    if layer == 2 and version == 3 and index:
        kbps = _KBPS[3, 2][index]
        if (kbps in (32, 48, 56, 80) and mode != 3) or (kbps >= 224 and mode == 3):
            return None
    kbps = _KBPS[3 if version == 3 else 2, layer][index]
    return Header(version, layer, not (word >> 16) & 1, kbps, _RATES[version][rate], (word >> 9) & 1, mode, (word >> 4) & 3)


def _layer2_bits(h: Header, body: bytes) -> int | None:
    """Allocation and scale-factor selection bits that the checksum covers."""
    per = h.kbps // h.channels
    if h.version != 3:
        runs = _ALLOC["lsf"]
    elif per in (32, 48):
        runs = _ALLOC["d" if h.rate == 32000 else "c"]
    elif h.rate == 48000 or 56 <= per <= 80:
        runs = _ALLOC["a"]
    else:
        runs = _ALLOC["b"]
    widths = [w for w, n in runs for _ in range(n)]
    bound = min(4 * (h.mode_ext + 1), len(widths)) if h.mode == 1 else len(widths)
    value, total, at, picked = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for k, w in enumerate(widths):
        shared = k >= bound
        for _ in range(1 if shared else h.channels):
            if at + w > total:
                return None
            if (value >> (total - at - w)) & ((1 << w) - 1):
                picked += h.channels if shared else 1
            at += w
    return at + 2 * picked


def check_frame(h: Header, frame: bytes) -> bool | None:
    """Whether the frame's checksum holds; None if it has none or it can't be located."""
    if not h.protected or len(frame) < 6:
        return None
    if h.layer == 1:
        bits = 8 * h.side_bytes
    elif h.layer == 3:
        bound = 4 * (h.mode_ext + 1) if h.mode == 1 else 32
        bits = 4 * (h.channels * bound + 32 - bound)
    else:
        found = _layer2_bits(h, frame[6:])
        if found is None:
            return None
        bits = found
    need = (bits + 7) // 8
    if len(frame) < 6 + need:
        return None
    return crc16(frame[2:4] + frame[6 : 6 + need], 16 + bits) == int.from_bytes(frame[4:6], "big")


@dataclass
class Stream:
    """What ``parse_stream`` finds."""

    header: Header | None = None
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    private: dict[str, bytes] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    #: Of a VBRI table: bytes from its own frame on, after every so many frames.
    table_points: list[int] = field(default_factory=list)
    table_step: int = 0
    delay: int = 0
    end_padding: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    resyncs: int = 0
    variable: bool = False

    @property
    def samples(self) -> int:
        """Exact length in samples, without the encoder's declared delay and padding."""
        total = len(self.offsets) * self.header.samples if self.header else 0
        return max(0, total - self.delay - self.end_padding)

    def seek(self, sample: int) -> int:
        """Byte offset of the frame that holds a sample (counted with the encoder's delay)."""
        if not self.header or not self.offsets:
            raise ValueError("no frames")
        return self.offsets[min(max(0, (sample + self.delay) // self.header.samples), len(self.offsets) - 1)]


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _resynchronised(b: bytes) -> bytes:
    """Undo unsynchronisation: the zero behind each 0xFF was put in so that no header shows up in a tag."""
    return b.replace(b"\xff\x00", b"\xff")


def _text_frame(b: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0] if b else 0, "latin-1")
    return b[1:].decode(codec, "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Read a tag at ``at``; where it ends (``at`` if there is none)."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return at
    major, flags = data[at + 3], data[at + 5]
    end = at + 10 + _syncsafe(data[at + 6 : at + 10]) + (10 if flags & 0x10 else 0)
    tag = data[at + 10 : min(end, len(data))]
    if flags & 0x80 and major < 4:
        tag = _resynchronised(tag)
    p, stop = 0, len(tag)
    if flags & 0x40 and p + 4 <= stop:
        p += _syncsafe(tag[p : p + 4]) if major == 4 else 4 + int.from_bytes(tag[p : p + 4], "big")
    head = 6 if major == 2 else 10
    while p + head <= stop and tag[p] != 0:
        if major == 2:
            name, size = tag[p : p + 3], int.from_bytes(tag[p + 3 : p + 6], "big")
        else:
            name = tag[p : p + 4]
            size = _syncsafe(tag[p + 4 : p + 8]) if major == 4 else int.from_bytes(tag[p + 4 : p + 8], "big")
        body = tag[p + head : min(p + head + size, stop)]
        if major == 4:
            form = tag[p + 9]
            body = body[4:] if form & 0x01 else body  # the length before the transformations below
            body = _resynchronised(body) if form & 0x02 or flags & 0x80 else body
            if form & 0x0C:  # compressed or encrypted: nothing that can be read here
                body = b""
        if name == b"PRIV" and b"\0" in body:
            owner, _, value = body.partition(b"\0")
            out.private[owner.decode("latin-1")] = value
        elif name[:1] == b"T" and body:
            out.tags[name.decode("latin-1")] = _text_frame(body)
        p += head + size
    return min(end, len(data))


def _tail_tags(data: bytes, start: int, end: int, out: Stream) -> int:
    """Strip ID3v1 and APE tags from the end."""
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        block = data[end - 128 : end]
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TDRC", 93, 97)):
            value = block[a:b].split(b"\0")[0].decode("latin-1").strip()
            if value:
                out.tags.setdefault(name, value)
        end -= 128
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I", data, end - 20)[0], struct.unpack_from("<I", data, end - 12)[0]
        whole = size + (32 if flags & 0x80000000 else 0)
        if 32 <= whole <= end - start:
            end -= whole
    return end


def _table(h: Header, frame: bytes, out: Stream) -> bool:
    """Whether the frame is a variable-bitrate table, which then is read."""
    if h.layer != 1:
        return False
    for at in (4 + h.side_bytes, 6 + h.side_bytes):
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            out.table = frame[at : at + 4].decode()
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            if flags & 1:
                out.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 2:
                out.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                out.toc, p = frame[p : p + 100], p + 100
            p += 4 if flags & 8 else 0
            if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= p + 24:
                packed = int.from_bytes(frame[p + 21 : p + 24], "big")
                out.delay, out.end_padding = packed >> 12, packed & 0xFFF
            return True
    if frame[36:40] == b"VBRI" and len(frame) >= 58:
        out.table = "VBRI"
        out.delay = 0
        out.table_bytes, out.table_frames = struct.unpack_from(">II", frame, 46)
        if len(frame) >= 62:
            entries, scale, width, out.table_step = struct.unpack_from(">4H", frame, 54)
            at, held = 0, frame[62 : 62 + entries * width] if 1 <= width <= 4 else b""
            for k in range(0, len(held) - width + 1, width):
                at += int.from_bytes(held[k : k + width], "big") * scale
                out.table_points.append(at)
        return True
    return False


def _free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """Length of a free-format frame: up to the next header of its kind; 0 if there is none."""
    p = data.find(b"\xff", at + 24, min(end, at + 8192))
    while p >= 0 and p + 4 <= end:
        n = parse_header(int.from_bytes(data[p : p + 4], "big"))
        if n and n.kbps == 0 and n.kin(h):
            return p - at
        p = data.find(b"\xff", p + 1, min(end, at + 8192))
    return 0


def parse_stream(data: bytes) -> Stream:
    """Tags, table, frames and checksums of a stream of bytes; never raises on bad input."""
    out = Stream()
    at = 0
    while (n := _id3v2(data, at, out)) != at:
        at = n
    end = _tail_tags(data, at, len(data), out)
    synced, free, first, kbps = False, 0, True, set()
    while at + 4 <= end:
        h = parse_header(int.from_bytes(data[at : at + 4], "big")) if data[at] == 0xFF else None
        if h and out.header and not h.kin(out.header):
            h = None
        size = 0
        if h:
            if h.kbps:
                size = h.length()
            else:
                free = free or _free_length(data, at, end, h)
                size = free + h.padding * (4 if h.layer == 3 else 1) if free else 0
            if size < 8 or at + size > end:
                h = None
        if h and not synced and at + size + 4 <= end:  # a lone pattern in junk is no frame: the next one must follow
            n = parse_header(int.from_bytes(data[at + size : at + size + 4], "big"))
            if n is None or not n.kin(h):
                h = None
        if not h:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            out.resyncs += synced
            at, synced = nxt, False
            continue
        frame = data[at : at + size]
        good = check_frame(h, frame)
        if good is not None:
            out.checked += 1
            out.failed += not good
        if first and _table(h, frame, out):
            out.header = h
        else:
            out.header = out.header or h
            out.offsets.append(at)
            out.lengths.append(size)
            kbps.add(h.kbps)
        first, synced, at = False, True, at + size
    out.skipped += max(0, end - at)
    out.variable = len(kbps) > 1
    return out


# == storing a payload ==

_OWNER = "payload.bytes"
_SIDE = 17
_HEAD = 6 + _SIDE


@lru_cache(maxsize=16)
def _shell(index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a mono MPEG-1 layer III frame at 32 kHz; its length."""
    word = 0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 2 << 10 | 3 << 6
    h = parse_header(word)
    assert h is not None
    head, side = word.to_bytes(4, "big"), bytes(_SIDE)
    return head + crc16(head[2:4] + side, 16 + 8 * _SIDE).to_bytes(2, "big") + side, h.length()


def encode_stream(payload: bytes) -> bytes:
    """A stream that holds ``payload``: the smallest bitrate that takes the rest, the largest while none does."""
    frames, at = [], 0
    while at < len(payload) or not frames:
        left = len(payload) - at
        index = next((i for i in range(1, 15) if _shell(i)[1] - _HEAD >= left), 14)
        shell, size = _shell(index)
        part = payload[at : at + size - _HEAD]
        frames.append(shell + part + bytes(size - _HEAD - len(part)))
        at += len(part)
    shell, size = _shell(1)
    total = size + sum(map(len, frames))
    starts, p = [], size
    for f in frames:
        starts.append(p)
        p += len(f)
    toc = bytes(min(255, starts[k * len(frames) // 100] * 256 // total) for k in range(100))
    body = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    table = shell + body + bytes(size - _HEAD - len(body))
    value = _OWNER.encode() + b"\0" + struct.pack(">Q", len(payload))
    priv = b"PRIV" + bytes((0, 0, 0, len(value))) + bytes(2) + value
    return b"ID3\x04\0\0" + bytes((0, 0, 0, len(priv))) + priv + table + b"".join(frames)


def decode_stream(data: bytes, stream: Stream) -> bytes:
    """The payload that ``encode_stream`` stored."""
    held = stream.private.get(_OWNER)
    if held is None or stream.failed:
        raise ValueError("no payload in this stream, or a checksum that does not hold")
    (size,) = struct.unpack(">Q", held)
    out = b"".join(data[a + _HEAD : a + n] for a, n in zip(stream.offsets, stream.lengths, strict=True))[:size]
    if len(out) != size:
        raise ValueError(f"{len(out)} of {size} bytes of payload")
    return out


def payload_of(text: bytes) -> bytes:
    """The text, zero-filled to a positive multiple of 64 bytes."""
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def describe(stream: Stream) -> str:
    """A feature string: format, counts, exact duration as samples over rate, and a digest of the seek offsets."""
    h = stream.header
    kind = f"mpeg{_VERSION[h.version]}-l{_LAYER[h.layer]} {h.rate}Hz {h.channels}ch" if h else "none"
    seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    return (
        f"{kind} frames={len(stream.offsets)} samples={stream.samples} {'vbr' if stream.variable else 'cbr'}"
        f" table={stream.table or '-'}:{stream.table_frames}:{stream.table_bytes} crc={stream.checked - stream.failed}/{stream.checked}"
        f" skipped={stream.skipped} resyncs={stream.resyncs} seek={seek:08x}"
    )


def encode_audio(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as an audio stream: (key, n_bytes, media)."""
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Small slices, so that a batch of very long texts is never held twice as a whole.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x.as_py() for x in part.column(1)]
                media = [encode_stream(payload_of(t)) for t in texts]
                yield pa.record_batch([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], [key, "n_bytes", "media"])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes bigint, media binary")


_PROBE = (
    "frames bigint, samples bigint, sample_rate int, channels int, variable boolean, vbr_table string, crc_checked bigint, crc_failed bigint, "
    "skipped bigint, tags map<string,string>, frame_offsets array<bigint>, payload binary, feature string"
)


def _probe(data: bytes | None, with_payload: bool) -> dict:
    data = data or b""
    s = parse_stream(data)
    payload = decode_stream(data, s) if with_payload and _OWNER in s.private else None
    h = s.header
    return {
        "frames": len(s.offsets), "samples": s.samples, "sample_rate": h.rate if h else None, "channels": h.channels if h else None,
        "variable": s.variable, "vbr_table": s.table or None, "crc_checked": s.checked, "crc_failed": s.failed, "skipped": s.skipped,
        "tags": list(s.tags.items()), "frame_offsets": s.offsets, "payload": payload, "feature": describe(s),
    }


def probe_audio(df: DataFrame, key: str = "doc_id", media: str = "media", with_payload: bool = False) -> DataFrame:
    """Parse each stream of a binary column: duration, checksums, tags and seek offsets (a null stream is empty)."""
    ship_package(df.sparkSession)
    source = df.select(key, media)
    schema = pa.schema([
        ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("variable", pa.bool_()),
        ("vbr_table", pa.string()), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped", pa.int64()),
        ("tags", pa.map_(pa.string(), pa.string())), ("frame_offsets", pa.list_(pa.int64())), ("payload", pa.binary()), ("feature", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_probe(x.as_py(), with_payload) for x in part.column(1)]
                cols = [pa.array([r[f.name] for r in rows], f.type) for f in schema]
                yield pa.record_batch([part.column(0), *cols], [key, *schema.names])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_PROBE}")


_DIGEST = pa.schema([
    ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("frames", pa.int64()), ("samples", pa.int64()), ("sample_rate", pa.int32()),
    ("frame_offsets", pa.list_(pa.int64())),
])
_DIGEST_DDL = (
    "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "frames bigint, samples bigint, sample_rate int, frame_offsets array<bigint>"
)


def _digest(n_bytes: int, media: bytes) -> tuple:
    s = parse_stream(media)
    p = decode_stream(media, s)
    return n_bytes, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(s), len(s.offsets), s.samples, s.header.rate, s.offsets


def _digest_batch(key: str, keys: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_DIGEST)
    return pa.record_batch([keys, *(pa.array(c, f.type) for c, f in zip(cols, _DIGEST, strict=True))], [key, *_DIGEST.names])


def digest_audio(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of stored streams (key, n_bytes, media): read back each payload and hash it together with its stored form.

    The exact duration is ``samples`` over ``sample_rate``; ``frame_offsets`` are the seek offsets of all frames.
    """
    ship_package(df.sparkSession)
    source = df.select(key, "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _digest_batch(key, part.column(0), [_digest(n.as_py(), x.as_py()) for n, x in zip(part.column(1), part.column(2), strict=True)])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_DIGEST_DDL}")


def digest_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``digest_audio`` of ``encode_audio``, in one pass: a stream is built, read back and dropped, one at a time.

    So no column of streams goes from Python to the executor and back, and a task has one Python worker, not two.
    """
    ship_package(df.sparkSession)
    source = df.select(key, text_or_empty(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = (x.as_py() for x in part.column(1))
                yield _digest_batch(key, part.column(0), [_digest(len(t), encode_stream(payload_of(t))) for t in texts])

    return source.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {_DIGEST_DDL}")
