"""MPEG audio columns: frame scan, tags, variable-bitrate tables, checksums, seek offsets.

``parse_mpeg`` walks the bytes of one stream. It skips ID3v2, ID3v1 and APE
tags, locks on to a frame header only where the next header (or the end of the
audio) follows at the computed distance, searches for the next such place after
damage, reads Xing/Info and VBRI tables, verifies the CRC-16 of protected
frames of all three layers, measures the frames of free-format streams, and keeps
exact durations (samples over sample rate) and the byte offset of every frame.

``store_payload`` writes arbitrary bytes as a valid MPEG-1 Layer III stream:
each frame holds silence (side information of zeros) and carries the bytes as
ancillary data, its format's unit. The last frame carries none, so nothing of the
payload lies where tags at the end of a file are looked for. ``load_payload`` reads
the bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.textblocks import pieces
from strandloom.runtime import ship_package

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by sample rate index.
_KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
# Fixed values of 11172-3 tables B.2a-d and 13818-3 table B.1: bits of a Layer II allocation, by subband.
_LAYER_2 = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}
_CRC_TABLE = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = (_c << 1 ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC_TABLE.append(_c)


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    hz: int
    channels: int
    samples: int
    length: int  # bytes of the frame; 0 where the format is free
    side: int  # bytes of side information (Layer III)
    pad: int = 0  # bytes of padding
    bound: int = 32  # first subband that both channels share


@dataclass
class Stream:
    frames: int = 0
    samples: int = 0
    hz: int = 0
    channels: int = 0
    layer: int = 0
    offsets: list[int] = field(default_factory=list)
    kbps: list[int] = field(default_factory=list)
    crc_checked: int = 0
    crc_failed: int = 0
    resyncs: int = 0
    skipped_bytes: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None

    @property
    def duration_s(self) -> float:
        return self.samples / self.hz if self.hz else 0.0

    @property
    def variable(self) -> bool:
        return len(set(self.kbps)) > 1

    def feature(self) -> str:
        """Exact facts of the stream as one line."""
        return (
            f"frames={self.frames};samples={self.samples};hz={self.hz};channels={self.channels};layer={self.layer};"
            f"vbr={int(self.variable)};kbps={sum(self.kbps)};crc={self.crc_checked - self.crc_failed}/{self.crc_checked};resyncs={self.resyncs}"
        )


_headers: dict[bytes, Header | None] = {}


def parse_header(four: bytes) -> Header | None:
    """The frame header in four bytes, None where they are none."""
    if four in _headers:
        return _headers[four]
    found = None
    if len(four) == 4 and four[0] == 0xFF and four[1] & 0xE0 == 0xE0:
        version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
        rate, speed, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
        if version != 1 and layer < 4 and rate < 15 and speed < 3:
            kbps, hz = _KBPS[1 if version == 3 else 2, layer][rate], _HZ[version][speed]
            mono = four[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
            length = 0 if not rate else (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
            side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
            found = Header(version, layer, not four[1] & 1, kbps, hz, 1 if mono else 2, samples, length, side, 4 * pad if layer == 1 else pad, 4 + 4 * (four[3] >> 4 & 3) if four[3] >> 6 == 1 else 32)
    if len(_headers) < 100_000:
        _headers[four] = found
    return found


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, start 0xFFFF, most significant bit first) of the first ``bits``, all by default."""
    bits = 8 * len(data) if bits is None else bits
    c = 0xFFFF
    for b in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ _CRC_TABLE[c >> 8 ^ b]
    for k in range(bits % 8):
        top = (c >> 15) ^ (data[bits // 8] >> (7 - k) & 1)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return c


def _checked_bits(h: Header, body: bytes) -> int:
    """How many bits after the checksum it covers; ``body`` starts there."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * h.channels + (32 - h.bound)) if h.channels == 2 else 4 * 32
    per = h.kbps // h.channels
    if h.version != 3:
        kind = "low"
    elif per >= 96 or (h.hz == 48000 and per >= 56):
        kind = "a" if h.hz == 48000 else "b"
    elif per >= 56:
        kind = "a"
    else:
        kind = "d" if h.hz == 32000 else "c"
    word, size, at, factors = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    for band, bits in enumerate(_LAYER_2[kind]):
        for _ in range(h.channels if band < h.bound else 1):
            at += bits
            if at <= size and word >> (size - at) & ((1 << bits) - 1):
                factors += h.channels if band >= h.bound else 1
    return at + 2 * factors


def _crc_holds(frame: bytes, h: Header) -> bool:
    bits = _checked_bits(h, frame[6:])
    if 48 + bits > 8 * len(frame):
        return False
    if h.layer == 3:
        return _crc_of(frame[2:4] + frame[6 : 6 + h.side]) == frame[4] << 8 | frame[5]
    return crc16(frame[2:4] + frame[6 : 6 + (bits + 7) // 8], 16 + bits) == frame[4] << 8 | frame[5]


_crcs: dict[bytes, int] = {}


def _crc_of(data: bytes) -> int:
    if data not in _crcs:
        if len(_crcs) > 50_000:
            _crcs.clear()
        _crcs[data] = crc16(data)
    return _crcs[data]


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads the tag at ``at`` and returns where it ends; ``at`` if there is none or it is broken."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return at
    major, end = data[at + 3], at + 10 + _synchsafe(data[at + 6 : at + 10])
    p = at + 10
    if major >= 3 and data[at + 5] & 0x40 and p + 4 <= len(data):
        p += _synchsafe(data[p : p + 4]) if major == 4 else 4 + int.from_bytes(data[p : p + 4], "big")
    head = 6 if major == 2 else 10
    while p + head <= min(end, len(data)) and data[p] != 0:
        name = data[p : p + (3 if major == 2 else 4)].decode("latin-1")
        if major == 2:
            size = int.from_bytes(data[p + 3 : p + 6], "big")
        else:
            size = _synchsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        body = data[p + head : min(p + head + size, end)]
        if name.startswith("T") and body:
            code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]] if body[0] < 4 else "latin-1"
            text = body[1:].decode(code, "replace").rstrip("\0")
            if name in ("TXXX", "TXX"):
                key, _, text = text.partition("\0")
                name = f"{name}:{key}"
            tags[name] = text
        p += head + size
    return min(end + (10 if major == 4 and data[at + 5] & 0x10 else 0), len(data))


def _tail(data: bytes, tags: dict[str, str]) -> int:
    """Where the audio ends: before an ID3v1 tag and an APE tag."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(name, text)
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        size += 32 if flags & 0x80000000 else 0
        if size <= end:
            end -= size
            tags["ape"] = "1"
    return end


def _table(frame: bytes, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the first frame."""
    at = 4 + 2 * h.protected + h.side
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p, found = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and p + 4 <= len(frame):
                found[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        if flags & 4 and p + 100 <= len(frame):
            found["toc"] = list(frame[p : p + 100])
            p += 100
        if flags & 8 and p + 4 <= len(frame):
            found["quality"] = int.from_bytes(frame[p : p + 4], "big")
        return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, quality, size, frames, n, scale, width, step = struct.unpack(">HHIIHHHH", frame[42:62])
        cells = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n) if 62 + (i + 1) * width <= len(frame)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "delay": delay, "quality": quality, "step": step, "toc": cells}
    return None


def _alike(a: Header, b: Header | None) -> bool:
    return b is not None and (a.layer, a.hz, a.version, not a.kbps) == (b.layer, b.hz, b.version, not b.kbps)


def _free_length(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a free-format frame without padding: the distance to the next header like it that another one, or the end, follows at the same distance. 0 if there is none."""
    farthest = min(end, at + (448 if h.layer == 1 else 384) * 1000 * h.samples // (8 * h.hz) + 8)
    p = at
    while (p := data.find(data[at : at + 2], p + 1, farthest)) > 0:
        n = parse_header(data[p : p + 4])
        size = p - at - h.pad
        if _alike(h, n) and size >= 4 + h.side:
            after = p + size + n.pad
            if after == end or _alike(h, parse_header(data[after : after + 4])):
                return size
    return 0


def _sized(h: Header, free: int) -> Header:
    """A free-format header with its frame's length and rate; others as they are."""
    return h if h.kbps or not free else replace(h, length=free + h.pad, kbps=round(free * 8 * h.hz / h.samples / 1000) or 1)


def _locked(data: bytes, at: int, end: int, like: Header | None) -> Header | None:
    """The header at ``at`` if the audio goes on, or ends, where its frame ends."""
    h = parse_header(data[at : at + 4])
    if h is None or (like and not _alike(like, h)):
        return None
    to = at + (h.length or (like.length - like.pad + h.pad if like else 0))
    if not h.length and not like:
        free = _free_length(data, at, end, h)
        if not free:
            return None
        to = at + free + h.pad
    if to > end:
        return None
    return h if to == end or _alike(h, parse_header(data[to : to + 4])) else None


def parse_mpeg(data: bytes) -> Stream:
    """Scan one stream. Bytes that are no audio give a stream of no frames."""
    s = Stream()
    at, end = _id3v2(data, 0, s.tags), _tail(data, s.tags)
    like: Header | None = None  # the first frame; of free format: with kbps 0 and its length
    lost, free = False, 0
    while at + 4 <= end:
        h = _locked(data, at, end, like)
        if h is None and like is not None and not lost:  # the last good frame before damage may be followed by anything
            h = parse_header(data[at : at + 4])
            if h and (at + _sized(h, free).length > end or not _alike(like, h)):
                h = None
        if h is None:
            tagged = _id3v2(data, at, s.tags)
            if tagged > at:
                at = tagged
                continue
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            s.resyncs += not lost
            s.skipped_bytes += nxt - at
            lost, at = True, nxt
            continue
        lost = False
        if like is None and not h.kbps:
            free = _free_length(data, at, end, h)
            like = replace(h, length=free + h.pad)
        first, h = s.layer == 0, _sized(h, free)
        if h.protected:
            s.crc_checked += 1
            s.crc_failed += not _crc_holds(data[at : at + h.length], h)
        if first:
            like, s.hz, s.channels, s.layer = like or h, h.hz, h.channels, h.layer
            s.vbr = _table(data[at : at + h.length], h) if h.layer == 3 else None
            if s.vbr:  # the table's frame is no audio
                at += h.length
                continue
        s.frames += 1
        s.samples += h.samples
        s.offsets.append(at)
        s.kbps.append(h.kbps)
        at += h.length
    s.skipped_bytes += max(0, end - at) if lost else 0
    return s


# The stored form: mono, 32 kHz, protected; bitrate index 14 for full frames.
_HEADERS = {i: bytes((0xFF, 0xFA, i << 4 | 2 << 2, 0xC4)) for i in range(1, 15)}
_HEAD = {}
for _i, _h in _HEADERS.items():
    _side = bytes(17)
    _HEAD[_i] = _h + crc16(_h[2:4] + _side).to_bytes(2, "big") + _side
_ROOM = {i: parse_header(h).length - len(_HEAD[i]) for i, h in _HEADERS.items()}


def store_payload(payload: bytes) -> bytes:
    """``payload`` as ancillary data of silent frames, after an ID3v2 tag and a Xing table."""
    note = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + bytes((0, 0, len(note) >> 7, len(note) & 0x7F, 0, 0)) + note
    tag = b"ID3\x04\x00\x00" + bytes((0, 0, len(frame) >> 7, len(frame) & 0x7F)) + frame
    full, body = _ROOM[14], []
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        i = 14 if len(part) == full else next(i for i in range(1, 15) if _ROOM[i] >= len(part))
        body += [_HEAD[i], part, bytes(_ROOM[i] - len(part))]
    body += [_HEAD[1], b"", bytes(_ROOM[1])]
    audio = b"".join(body)
    frames = len(body) // 3
    room = next(i for i in range(1, 15) if _ROOM[i] >= 116)
    info = b"Xing" + struct.pack(">III", 7, frames, len(audio)) + bytes(256 * k // 100 for k in range(100))
    return tag + _HEAD[room] + info + bytes(_ROOM[room] - len(info)) + audio


def load_payload(media: bytes) -> tuple[bytes, Stream]:
    """The bytes that ``store_payload`` stored, and the scan of their stream."""
    s = parse_mpeg(media)
    size = int(s.tags["TXXX:payload_bytes"])
    skip = len(_HEAD[14])
    parts = [media[a + skip : a + parse_header(media[a : a + 4]).length] for a in s.offsets]
    return b"".join(parts)[:size], s


def media_columns(docs: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """Scan a binary column of MPEG audio; a null stream has no frames. One row per row, any key."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(column).alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "media"):
                s = [parse_mpeg(x.as_py() or b"") for x in part.column(1)]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_frames": pa.array([x.frames for x in s], pa.int64()),
                        "n_samples": pa.array([x.samples for x in s], pa.int64()),
                        "sample_rate": pa.array([x.hz for x in s], pa.int64()),
                        "duration_s": pa.array([x.duration_s for x in s], pa.float64()),
                        "crc_checked": pa.array([x.crc_checked for x in s], pa.int64()),
                        "crc_failed": pa.array([x.crc_failed for x in s], pa.int64()),
                        "resyncs": pa.array([x.resyncs for x in s], pa.int64()),
                        "seek_offsets": pa.array([x.offsets for x in s], pa.list_(pa.int64())),
                        "tags": pa.array([list(x.tags.items()) for x in s], pa.map_(pa.string(), pa.string())),
                    }
                )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, n_frames long, n_samples long, sample_rate long, duration_s double, crc_checked long, crc_failed long, resyncs long, seek_offsets array<long>, tags map<string,string>")


def text_as_media(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes and the MPEG stream of each text's padded UTF-8 (null: empty).

    One row for each row of ``docs``, whatever its key, repeated rows included; equal texts have equal streams. Only ``key`` and ``text`` are read.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw = [x.as_py() or b"" for x in part.column(1).cast(pa.binary())]
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_bytes": pa.array([len(x) for x in raw], pa.int64()),
                        "media": pa.array([store_payload(x + bytes(max(64, -(-len(x) // 64) * 64) - len(x))) for x in raw], pa.binary()),
                    }
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, media binary")


def payload_digests(media: DataFrame) -> DataFrame:
    """Read stored streams back: digests of payload and stream, and the scan's features."""
    ship_package(media.sparkSession)
    rows = media.select("doc_id", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s")}
            for x in batch.column(2):
                stored = x.as_py()
                payload, s = load_payload(stored)
                for k, v in zip(
                    out,
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), s.feature(), s.duration_s),
                ):
                    out[k].append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(1)} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double")
