"""Operator 10: texts kept as MPEG audio columns.

``encode`` puts a payload into a valid frame stream: an ID3v2 tag, a frame with
the variable-bitrate table ("Xing": frame count, byte count, 100-entry seek
table), one checksummed MPEG-1 Layer III mono frame for each 192 payload bytes
(the format's unit here), and an ID3v1 tag.  Frames use two bitrates, so their
sizes vary and seek offsets are not a multiplication.

``decode`` knows nothing of ``encode``: it reads tags (ID3v1, v2.2 to v2.4 in their
encodings), knows MPEG-1, 2 and 2.5 and both kinds of tables (Xing, VBRI), finds frame headers by
resynchronising (a header counts if the next one stands where it says or the
stream ends there; failing that, if the frame before led to it and its checksum
holds), parses the table, verifies each frame's CRC-16 and
returns payload, exact duration and the byte offset of each frame.

Defined cases: null and empty texts are one unit of spaces; equal texts give
equal columns; garbage between frames is skipped and counted; extra input
columns are ignored; an empty table gives an empty result.  A very long text is
framed whole; seek offsets are 32 bits wide, so the stored form of a text must stay
below 4 GB (some 1.4 GB of text), above which Arrow can't hold it as a value either.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuskiln.llm.common import in_batches, load, raw_texts

UNIT = 192
RATE, SAMPLES = 48_000, 1152
#: Fixed values of the format, Layer III: kbit/s by header index for MPEG-1 and for MPEG-2 and 2.5.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
#: Fixed values of the format: samples a second by header index for version bits 3 (MPEG-1), 2 (MPEG-2), 0 (MPEG-2.5).
RATES = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}
SIDE = 17
MAIN = 4 + 2 + SIDE
SMALL, LARGE = 6, 7


def crc16(data: bytes) -> int:
    """The format's checksum: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


def _own_header(index: int) -> bytes:
    # sync, MPEG-1, Layer III, with checksum | bitrate, 48 kHz, no padding | mono
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))


@dataclass(frozen=True)
class Header:
    """What a Layer III frame header says: bytes of the frame and of its side information, samples, rate, kbit/s, checksum."""

    size: int
    side: int
    samples: int
    rate: int
    kbits: int
    protected: bool


@lru_cache(maxsize=4096)
def header(data: bytes) -> Header | None:
    """The header that four bytes are, or None: MPEG-1, 2 and 2.5, Layer III, of a stated bitrate."""
    if len(data) < 4 or data[0] != 0xFF or data[1] & 0xE6 != 0xE2:
        return None
    version, index, rate, pad = data[1] >> 3 & 3, data[2] >> 4, data[2] >> 2 & 3, data[2] >> 1 & 1
    if version == 1 or index in (0, 15) or rate == 3:
        return None
    full, mono = version == 3, data[3] >> 6 == 3
    kbits, hertz = (KBITS if full else KBITS_LOW)[index], RATES[version][rate]
    side = (17 if mono else 32) if full else (9 if mono else 17)
    return Header((144_000 if full else 72_000) * kbits // hertz + pad, side, 1152 if full else 576, hertz, kbits, not data[1] & 1)


def frame_size(data: bytes) -> int:
    """Bytes of the frame a header announces; 0 if it isn't one."""
    found = header(bytes(data[:4]))
    return found.size if found else 0


def _prefix(index: int) -> bytes:
    head, side = _own_header(index), bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_PREFIX = {i: _prefix(i) for i in (SMALL, LARGE)}
_SIZE = {i: frame_size(_own_header(i)) for i in (SMALL, LARGE)}
_TAIL = {i: bytes(_SIZE[i] - MAIN - UNIT) for i in (SMALL, LARGE)}


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """The stored form of a payload, a positive multiple of 192 bytes."""
    title = b"\x03" + hashlib.sha256(payload).hexdigest()[:16].encode()
    tag_frame = b"TIT2" + _syncsafe(len(title)) + b"\0\0" + title
    tag = b"ID3\x04\0\0" + _syncsafe(len(tag_frame)) + tag_frame
    kinds, parts = [], []
    for at in range(0, len(payload), UNIT):
        unit = payload[at : at + UNIT]
        kind = LARGE if len(set(unit)) > 24 else SMALL
        kinds.append(kind)
        parts += (_PREFIX[kind], unit, _TAIL[kind])
    n, first = len(kinds), _SIZE[LARGE]
    total = first + sum(_SIZE[k] for k in kinds)
    ends, at = [], first
    for k in kinds:
        ends.append(at)
        at += _SIZE[k]
    toc = bytes(min(255, ends[n * i // 100] * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    info = _PREFIX[LARGE] + table
    return b"".join([tag, info, bytes(first - len(info)), *parts, b"TAG" + title[1:].ljust(30, b"\0") + bytes(94) + b"\xff"])


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    frames: int = 0
    offsets: list[int] = field(default_factory=list)
    kbits: list[int] = field(default_factory=list)
    bad_checksums: int = 0
    skipped: int = 0
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    samples: int = 0
    rate: int = 0


def _text(raw: bytes) -> str:
    """A text frame: its first byte names the encoding."""
    kinds = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    return raw[1:].decode(kinds.get(raw[0], "latin-1"), "replace").rstrip("\0") if raw else ""


def _safe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def tags_before(data: bytes, out: Audio) -> int:
    """Reads an ID3v2 tag (2.2, 2.3 or 2.4) at the start; the place behind it."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    version, flags = data[3], data[5]
    stop, at = min(len(data), 10 + _safe(data[6:10])), 10
    body = data[:stop].replace(b"\xff\x00", b"\xff") if flags & 0x80 and version < 4 else data  # unsynchronised as a whole
    last = min(stop, len(body))
    if flags & 0x40 and version > 2:  # an extended header; 2.4 counts its size field in
        at += _safe(body[at : at + 4]) if version == 4 else 4 + int.from_bytes(body[at : at + 4], "big")
    wide, head = (3, 6) if version == 2 else (4, 10)
    while at + head <= last and body[at] != 0:
        name, raw = body[at : at + wide], body[at + wide : at + 2 * wide]
        n = _safe(raw) if version == 4 else int.from_bytes(raw, "big")
        if name[:1] == b"T":
            out.tags[name.decode("latin-1")] = _text(body[at + head : min(at + head + n, last)])
        at += head + n
    return min(len(data), stop + (10 if flags & 0x10 and version == 4 else 0))  # 2.4 may have a footer


def table_of(frame: bytes, body: int, out: Audio) -> bool:
    """Reads the table of a variable-bitrate stream, if the frame is one: 'Xing' or 'Info' behind the side information,
    or 'VBRI' 32 bytes behind the header."""
    if frame[body : body + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(frame[body + 4 : body + 8], "big"), body + 8
        if flags & 1:
            out.table_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            out.table_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        out.toc = frame[p : p + 100] if flags & 4 else b"-"
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        out.table_bytes, out.table_frames = struct.unpack(">II", frame[46:54])
        entries, _, wide, _ = struct.unpack(">HHHH", frame[54:62])
        out.toc = frame[62 : 62 + entries * wide] or b"-"
        return True
    return False


def decode(data: bytes, unit: int = UNIT) -> Audio:
    out, end = Audio(), len(data)
    at = tags_before(data, out)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["v1"] = data[end + 3 : end + 33].rstrip(b"\0").decode("latin-1")
    sums: dict[bytes, int] = {}
    payload, led = [], False
    while at < end:
        found = header(data[at : at + 4])
        following = at + (found.size if found else 0)
        leads = found is not None and (following == end or following < end and header(data[following : following + 4]) is not None)
        holds = False
        body = at
        if found:
            body = at + 4 + 2 * found.protected + found.side
            if found.protected:
                covered = data[at + 2 : at + 4] + data[at + 6 : body]
                want = sums.get(covered)
                if want is None:
                    want = sums[covered] = crc16(covered)
                holds = want == (data[at + 4] << 8 | data[at + 5])
        if not leads and not (led and holds and following <= end):
            nxt = data.find(b"\xff", at + 1, end)  # resynchronise
            nxt = nxt if nxt >= 0 else end
            out.skipped += nxt - at
            at, led = nxt, False
            continue
        led = leads
        out.bad_checksums += found.protected and not holds
        if out.frames or out.toc or not table_of(data[at:following], body - at, out):
            out.frames += 1
            out.samples += found.samples
            out.rate = out.rate or found.rate
            out.offsets.append(at)
            out.kbits.append(found.kbits)
            payload.append(data[body : body + unit])
        at = following
    out.payload = b"".join(payload)
    return out


def feature(audio: Audio) -> str:
    """Duration in exact samples, bitrates, checksums, table and a digest of all seek offsets."""
    seek = hashlib.sha256(struct.pack(f">{len(audio.offsets)}I", *audio.offsets)).hexdigest()[:16]
    mean = sum(audio.kbits) / max(1, len(audio.kbits))
    return f"samples={audio.samples};ms={audio.samples * 1000 // (audio.rate or RATE)};frames={audio.frames};kbits={mean:.3f};bad={audio.bad_checksums};skipped={audio.skipped};table={audio.table_frames},{audio.table_bytes};seek={seek}"


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b" " * (-len(text) % UNIT or UNIT * (not text))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, seek_offsets array<int>, media binary"


def to_media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """One row per document with its stored audio, what was read back and the features.
    ``keep_media=False`` leaves the stored bytes and the seek offsets null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in raw_texts(batch.column("text")):
                stored = encode(padded(text))
                audio = decode(stored)
                back = audio.payload
                rows.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(audio), audio.samples, audio.offsets if keep_media else None, stored if keep_media else None))
            columns = list(zip(*rows)) or [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_samples", "seek_offsets", "media")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=list(names))

    return in_batches(docs.select("doc_id", "text"), run, SCHEMA)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_media(load(spark, sf_dir, "documents"), keep_media=False).drop("seek_offsets", "media")
