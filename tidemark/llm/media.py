"""Operator 6, media columns: MPEG audio streams in a binary column.

A stream is walked frame by frame from its headers: tags before and after it are parsed, bytes that are no frame are
skipped until a header that another one (or the end) follows at the right distance, variable-bitrate tables are read,
with their seek tables and the encoder's delay and padding, and the checksums of protected frames of all three layers
are verified: over the side information in Layer III, the bit allocation in Layer I, and that with the scale factor
selection in Layer II. Durations are exact: samples and sample rate are stored as integers, and seconds are the quotient
of the samples without delay and padding. Every frame's offset is kept for seeking. Free-format frames are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, small_batches

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBPS = {
    (1, 3): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 1): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 3): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 1): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SCHEMA = (
    "valid boolean, layer int, version double, channels int, sample_rate int, n_samples long, duration_s double, n_frames int,"
    " mean_kbps double, vbr string, vbr_frames long, vbr_bytes long, n_checked int, n_bad_crc int, n_resyncs int, n_skipped long,"
    " title string, artist string, encoder_delay int, encoder_padding int, seek_table array<long>, frame_offsets array<long>"
)
_heads: dict[int, tuple | None] = {}


def header(four: int) -> tuple[int, int, int, int, int, bool, int, int] | None:
    """(frame length, version bits, layer bits, sample rate, samples, protected, channels, kbps) of a header; free format is none."""
    if four in _heads:
        return _heads[four]
    version, layer, rate, index = four >> 19 & 3, four >> 17 & 3, four >> 10 & 3, four >> 12 & 15
    found = None
    if four >> 21 == 0x7FF and version != 1 and layer and rate != 3 and index not in (0, 15):
        kbps = _KBPS[1 if version == 3 else 2, layer][index]
        hz, pad = _RATES[version][rate], four >> 9 & 1
        if layer == 3:
            size, samples = (12000 * kbps // hz + pad) * 4, 384
        else:
            samples = 576 if layer == 1 and version != 3 else 1152
            size = samples // 8 * 1000 * kbps // hz + pad
        found = (size, version, layer, hz, samples, not four >> 16 & 1, 1 if four >> 6 & 3 == 3 else 2, kbps)
    if len(_heads) < 1 << 16:
        _heads[four] = found
    return found


def side_bytes(version: int, channels: int) -> int:
    return (17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17)


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[b] = c
    return out


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def crc16(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of a byte matrix."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ _CRC[(c >> np.uint16(8)) ^ rows[:, k]]
    return c


def _layer2_bits(version: int, hz: int, kbps: int, channels: int) -> list[int]:
    """Bits of the allocation of each subband."""
    if version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = kbps // channels
    if each <= 48:
        return [4] * 2 + [3] * (10 if hz == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or hz == 48000 else 7)


def checked_bits(frame: bytes, info: tuple) -> int | None:
    """How many bits after the checksum of a protected frame of Layer I or II it covers; None where the frame is too short."""
    channels, body = info[6], frame[6:]
    bound = 4 + 4 * (frame[3] >> 4 & 3) if frame[3] >> 6 == 1 else 32  # joint stereo shares the allocation from there on
    if info[2] == 3:
        return min(bound, 32) * 4 * channels + (32 - min(bound, 32)) * 4
    bits, at, chosen = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 0, 0
    for band, n in enumerate(_layer2_bits(info[1], info[3], info[7], channels)):
        for _ in range(channels if band < bound else 1):
            if bits >> 512 - at - n & (1 << n) - 1:
                chosen += 1 if band < bound else channels
            at += n
    total = at + 2 * chosen
    return total if total <= 8 * len(body) else None


def crc_of(frame: bytes, count: int) -> int:
    """CRC-16 of the last two header bytes and so many bits after the checksum."""
    c = 0xFFFF
    whole = frame[2:4] + frame[6 : 6 + count // 8]
    for b in whole:
        c = (c << 8 & 0xFFFF) ^ _CRC_LIST[c >> 8 ^ b]
    for k in range(count % 8):
        bit = frame[6 + count // 8] >> 7 - k & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if c >> 15 ^ bit else 0)
    return c


def _text(raw: bytes) -> str | None:
    if not raw:
        return None
    code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0])
    return raw[1:].decode(code, "replace").split("\0")[0] if code else None


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def tags(data: bytes) -> tuple[int, int, str | None, str | None]:
    """(where the audio begins, where it ends, title, artist) by ID3v2 before it and ID3v1 after it."""
    begin, end, title, artist = 0, len(data), None, None
    while data[begin : begin + 3] == b"ID3" and end - begin >= 10:
        major, flags, size = data[begin + 3], data[begin + 5], _syncsafe(data[begin + 6 : begin + 10])
        at, stop = begin + 10, min(end, begin + 10 + size)
        if flags & 0x40 and major > 2 and at + 4 <= stop:
            at += _syncsafe(data[at : at + 4]) if major == 4 else int.from_bytes(data[at : at + 4], "big") + 4
        raw = data[at:stop]
        if flags & 0x80:
            raw = raw.replace(b"\xff\x00", b"\xff")
        wide, at = 6 if major == 2 else 10, 0
        while at + wide <= len(raw) and raw[at]:
            name = raw[at : at + (3 if major == 2 else 4)]
            n = int.from_bytes(raw[at + 3 : at + 6], "big") if major == 2 else _syncsafe(raw[at + 4 : at + 8]) if major == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
            body = raw[at + wide : at + wide + n]
            if name in (b"TIT2", b"TT2"):
                title = title or _text(body)
            elif name in (b"TPE1", b"TP1"):
                artist = artist or _text(body)
            at += wide + n
        begin = min(end, begin + 10 + size + (10 if flags & 0x10 else 0))
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        old = data[end - 128 : end]
        end -= 128
        title = title or old[3:33].split(b"\0")[0].decode("latin-1").rstrip() or None
        artist = artist or old[33:63].split(b"\0")[0].decode("latin-1").rstrip() or None
    return begin, end, title, artist


def _table(frame: bytes, info: tuple) -> tuple[str, int | None, int | None, int, int, list[int]] | None:
    """(kind, frames, bytes, encoder delay, padding, seek table) of the table that a first frame may hold in place of sound.

    The seek table has bytes from the table's frame on, at equal steps of time.
    """
    for skip in (0, 2) if info[5] else (0,):
        at = 4 + skip + side_bytes(info[1], info[6])
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            n = size = None
            seek: list[int] = []
            delay = padding = 0
            if flags & 1:
                n, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 2:
                size, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
            if flags & 4:
                seek, p = [x * (size or 0) // 256 for x in frame[p : p + 100]], p + 100
            if flags & 8:
                p += 4
            if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf", b"GOGO") and p + 24 <= len(frame):
                both = int.from_bytes(frame[p + 21 : p + 24], "big")
                delay, padding = both >> 12, both & 0xFFF
            return frame[at : at + 4].decode(), n, size, delay, padding, seek
    if frame[36:40] == b"VBRI":
        entries, scale, wide = (int.from_bytes(frame[k : k + 2], "big") for k in (54, 56, 58))
        steps = [int.from_bytes(frame[k : k + wide], "big") * scale for k in range(62, min(len(frame) - wide + 1, 62 + entries * wide), wide)] if 0 < wide <= 4 else []
        seek = [sum(steps[:k]) for k in range(len(steps))] if len(steps) < 1000 else np.cumsum([0, *steps[:-1]]).tolist()
        return "VBRI", int.from_bytes(frame[50:54], "big"), int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[42:44], "big"), 0, seek
    return None


def parse(data: bytes | None) -> tuple:
    """The values of SCHEMA for one stream, without verified checksums; then (offset, rows to verify)."""
    if not data:
        return (False, None, None, None, None, 0, 0.0, 0, None, None, None, None, 0, 0, 0, 0, None, None, None, None, [], []), []
    begin, end, title, artist = tags(data)
    at, resyncs, skipped, stream, vbr = begin, 0, 0, None, None
    offsets, protected, bits, lost = [], [], 0, False
    key = None
    while at + 4 <= end:
        info = header(int.from_bytes(data[at : at + 4], "big")) if data[at] == 0xFF else None
        if info and at + info[0] <= end and (key is None or info[1:4] == key):
            to = at + info[0]
            if key is None or lost:  # after a gap a header alone isn't trusted
                after = header(int.from_bytes(data[to : to + 4], "big")) if to + 4 <= end else info
                if not after or after[1:4] != info[1:4]:
                    info = None
        else:
            info = None
        if info is None:
            if not lost and offsets:
                resyncs += 1
            lost = True
            near = data.find(b"\xff", at + 1, end)
            near = end if near < 0 else near
            skipped += near - at
            at = near
            continue
        lost = False
        if key is None:
            key, stream = info[1:4], info
            vbr = _table(data[at : at + info[0]], info)
            if vbr:
                at += info[0]
                continue
        offsets.append(at)
        bits += info[7]
        if info[5]:
            protected.append(at)
        at += info[0]
    if at < end:
        skipped += end - at
    if stream is None:
        return (False, None, None, None, None, 0, 0.0, 0, None, None, None, None, 0, 0, 0, skipped, title, artist, None, None, [], []), []
    n, samples, hz = len(offsets), len(offsets) * stream[4], stream[3]
    kind, total, size, delay, padding, seek = vbr or (None, None, None, 0, 0, [])
    heard = max(0, samples - delay - padding)
    row = (
        True, 4 - stream[2], {3: 1.0, 2: 2.0, 0: 2.5}[stream[1]], stream[6], hz, samples, heard / hz, n, bits / n if n else None,
        kind, total, size, len(protected), 0, resyncs, skipped, title, artist, delay, padding, seek, offsets,
    )
    return row, protected


def media_rows(streams: list[bytes | None]) -> list[tuple]:
    """SCHEMA's values for each stream; the checksums of all of them are computed together."""
    rows, where, taken = [], [], {}
    for k, data in enumerate(streams):
        row, protected = parse(data)
        rows.append(list(row))
        for at in protected:
            info = header(int.from_bytes(data[at : at + 4], "big"))
            if info[2] != 1:
                frame = data[at : at + info[0]]
                count = checked_bits(frame, info)
                rows[-1][13] += count is None or crc_of(frame, count) != int.from_bytes(frame[4:6], "big")
                continue
            size = side_bytes(info[1], info[6])
            taken.setdefault(size, []).append(data[at + 2 : at + 4] + data[at + 6 : at + 6 + size] + data[at + 4 : at + 6])
            where.append((k, size, len(taken[size]) - 1))
    bad = {}
    for size, raw in taken.items():
        m = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), size + 4)
        bad[size] = crc16(m[:, :-2]) != (m[:, -2].astype(np.uint16) << np.uint16(8) | m[:, -1])
    for k, size, i in where:
        rows[k][13] += int(bad[size][i])
    return [tuple(r) for r in rows]


_NAMES = [x.split()[0] for x in SCHEMA.split(",")]
_TYPES = [pa.bool_(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def media_columns(batches: Iterator[pa.RecordBatch], key: str, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = list(zip(*media_rows(batch.column(column).to_pylist())))
        yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, t) for c, t in zip(cols, _TYPES))], [key, *_NAMES])


def media_info(media: DataFrame, key: str, column: str = "audio") -> DataFrame:
    """(key, SCHEMA's columns) for each row's stream.

    A null or empty stream, or one without a frame, isn't valid and has no duration; bytes that are no frame are counted
    as skipped; repeated rows and null keys are kept; an empty table gives an empty one. Streams of any length are
    walked to their end. Other columns are never read. Rows stay where they are: no shuffle.
    """
    small_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(lean(lambda it: media_columns(it, key, column), 500), f"`{key}` {kind}, {SCHEMA}")


# -- streams made from the documents, as the tables have no audio --


def stream_of(doc: int, text: str | None, source: str | None) -> bytes | None:
    """A stream whose frames carry a document's bytes: tags, a table, checksums and damage vary with the id."""
    if text is None:
        return None
    doc, raw = doc or 0, text.encode()
    layer3 = 0xFFE00000 | 3 << 19 | 1 << 17
    protected = doc % 2 == 0
    rate = doc % 3
    base = layer3 | (0 if protected else 1 << 16) | rate << 10 | (3 << 6 if doc % 5 == 0 else 0)
    out = []
    if doc % 4 != 3:
        name = b"\x03" + (source or "").encode()
        body = b"TIT2" + len(name).to_bytes(4, "big") + b"\0\0" + name
        out.append(b"ID3\x03\0\0" + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body)
    indexes = (9, 11, 7, 5) if doc % 3 == 0 else (9,)
    head = [base | i << 12 for i in indexes]
    infos = [header(h) for h in head]
    side = side_bytes(3, infos[0][6])
    frames, at, k, damage = [], 0, 0, (doc % 11 == 0)
    while at < len(raw):
        h, info = head[k % len(head)], infos[k % len(head)]
        room = info[0] - 4 - (2 if protected else 0)
        body = raw[at : at + room].ljust(room, b"\0")
        start = h.to_bytes(4, "big")
        if protected:
            c = 0xFFFF
            for b in start[2:] + body[:side]:
                c = (c << 8 & 0xFFFF) ^ _CRC_LIST[c >> 8 ^ b]
            start += (c ^ (1 if damage and k == 1 else 0)).to_bytes(2, "big")
        if doc % 7 == 0 and k == 2:
            frames.append(b"junk\xffjunk")
        frames.append(start + body)
        at += room
        k += 1
    if doc % 3 == 0 and k:
        plain = head[0] | 1 << 16
        table = plain.to_bytes(4, "big") + bytes(side) + b"Xing" + (15).to_bytes(4, "big") + k.to_bytes(4, "big") + sum(map(len, frames)).to_bytes(4, "big")
        table += bytes(i * 256 // 100 for i in range(100)) + (50).to_bytes(4, "big") + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | min(4095, len(frames[-1]))).to_bytes(3, "big")
        frames.insert(0, table.ljust(header(plain)[0], b"\0"))
    out += frames
    if doc % 6 == 1:
        out.append(b"TAG" + (source or "").encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(95))
    return b"".join(out)


def document_streams(docs: DataFrame) -> DataFrame:
    """(doc_id, media columns) of the streams made from ``docs``; made and parsed in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [stream_of(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "source")))]
            yield from media_columns(iter([pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.large_binary())], ["doc_id", "audio"])]), "doc_id", "audio")

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text", "source").mapInArrow(lean(run, 500), f"doc_id long, {SCHEMA}")
