"""MPEG audio as a column: writing bytes into a stream, and reading streams back frame by frame.

The writer makes MPEG-1 Layer III frames of 224 kbit/s at 48 kHz, mono, CRC protected, 672 bytes each: 4 of header,
2 of checksum, 17 of side information and 649 of main data, of which 576 carry payload.  An ID3v2 tag, a frame with
a variable-bitrate table and an ID3v1 tag surround them.

The reader takes any bytes.  It skips tags, finds the first frame header that a second one (or the end) confirms,
follows the headers' own lengths, looks for the next confirmed header where one is damaged, parses Xing, Info and
VBRI tables, verifies checksums, and gives exact durations and frame offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.store import keep
from trackloom.llm.text import blobs

#: Fixed values of the format: kbit/s by (version 1 or 2, layer) and header index, sample rates of MPEG-1, samples a
#: frame by (version, layer).
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

HEADER, FRAME, UNIT, SIDE = bytes([0xFF, 0xFA, 0xC4, 0xC0]), 672, 576, 17
DATA_AT = 4 + 2 + SIDE
MAX_TOC = 100


def _crc_table() -> np.ndarray:
    """CRC-16 of the format: polynomial 0x8005, most significant bit first."""
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes."""
    out = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        out = ((out << 8) & 0xFFFF) ^ _CRC[(out >> 8) ^ column]
    return out


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _protected(frames: np.ndarray) -> None:
    crc = crc16(np.concatenate([frames[:, 2:4], frames[:, 6:DATA_AT]], axis=1))
    frames[:, 4], frames[:, 5] = crc >> 8, crc & 0xFF


def _allocation(family: int, kbits: int, hz: int, channels: int) -> list[int]:
    """Bits of the allocation of each subband of Layer II, by the format's tables."""
    if family == 2:
        runs = ((4, 4), (3, 7), (2, 19))
    elif kbits // channels <= 48:
        runs = ((4, 2), (3, 10)) if hz == 32000 else ((4, 2), (3, 6))
    elif kbits // channels <= 80 or hz == 48000:
        runs = ((4, 11), (3, 12), (2, 4))
    else:
        runs = ((4, 11), (3, 12), (2, 7))
    return [width for width, n in runs for _ in range(n)]


def checked_bits(data: bytes, at: int, found: tuple) -> int:
    """How many bits behind the checksum of the frame at ``at`` it covers: the side information of Layer III, the bit
    allocation of Layer I, and that and the choice of scale factors of Layer II."""
    family, layer, _, hz, _, side = found
    if layer == 3:
        return 8 * side
    channels = 1 if data[at + 3] >> 6 == 3 else 2
    bound = 4 * ((data[at + 3] >> 4 & 3) + 1) if data[at + 3] >> 6 == 1 else 32
    if layer == 1:
        return 4 * 32 if channels == 1 else 4 * (32 + bound)
    held, n, chosen = int.from_bytes(data[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big"), 0, 0
    for band, width in enumerate(_allocation(family, KBITS[family, layer][data[at + 2] >> 4], hz, channels)):
        for _ in range(channels if band < bound else 1):
            n += width
            some = held >> (512 - n) & (1 << width) - 1
            chosen += (some > 0) * (1 if band < bound else channels)
    return n + 2 * chosen


def _crc_bits(data: bytes, at: int, bits: int) -> int:
    """The checksum over the header's second half and ``bits`` behind the checksum."""
    size = -(-bits // 8)
    left = (int.from_bytes(data[at + 2 : at + 4], "big") << bits) | int.from_bytes(data[at + 6 : at + 6 + size], "big") >> 8 * size - bits
    out = 0xFFFF
    for k in range(bits + 15, -1, -1):
        top = (out >> 15) ^ (left >> k & 1)
        out = (out << 1 & 0xFFFF) ^ (0x8005 if top else 0)
    return out


def encode(payload: bytes, title: str = "text") -> bytes:
    """The stream that carries ``payload``, whose length is a positive multiple of 576."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(units) + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    frames[1:, DATA_AT : DATA_AT + UNIT] = units
    size = frames.size
    toc = bytes(min(255, 256 * ((len(units) * i // MAX_TOC + 1) * FRAME) // size) for i in range(MAX_TOC))
    table = b"Info" + (7).to_bytes(4, "big") + len(units).to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    frames[0, DATA_AT : DATA_AT + len(table)] = np.frombuffer(table, np.uint8)
    _protected(frames)
    name = b"\x03" + title.encode()
    body = b"TIT2" + _syncsafe(len(name)) + b"\0\0" + name
    tag = b"ID3\x04\0\0" + _syncsafe(len(body)) + body
    old = b"TAG" + title.encode("latin-1", "replace")[:30].ljust(124, b"\0") + b"\xff"
    return tag + frames.tobytes() + old


def header(data: bytes, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """(version, layer, frame bytes, samples a second, protected, side bytes) of the header at ``at``, if it is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = (data[at + 1] >> 3) & 3, 4 - ((data[at + 1] >> 1) & 3)
    kbits, rate = data[at + 2] >> 4, (data[at + 2] >> 2) & 3
    if version == 1 or layer == 4 or kbits in (0, 15) or rate == 3:
        return None
    family = 1 if version == 3 else 2
    hz = RATES[rate] >> (0, 1, 2)[{3: 0, 2: 1, 0: 2}[version]]
    bits, pad = KBITS[family, layer][kbits] * 1000, (data[at + 2] >> 1) & 1
    size = (12 * bits // hz + pad) * 4 if layer == 1 else SAMPLES[family, layer] // 8 * bits // hz + pad
    mono = data[at + 3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return family, layer, size, hz, not data[at + 1] & 1, side


def _confirmed(data: bytes, at: int, end: int) -> bool:
    found = header(data, at)
    if not found or at + found[2] > end:
        return False
    then = at + found[2]
    after = header(data, then)
    return then == end or bool(after and after[:2] == found[:2] and after[3] == found[3])


def _sync(data: bytes, at: int, end: int, before: int | None = None) -> int:
    """The first confirmed header from ``at`` and before ``before``, or ``end``."""
    while 0 <= (at := data.find(b"\xff", at, before or end)):
        if _confirmed(data, at, end):
            return at
        at += 1
    return end


def _table(data: bytes, at: int, found: tuple) -> dict | None:
    """The variable-bitrate table in the Layer III frame at ``at``, if it is one."""
    if found[1] != 3:
        return None
    start = at + 4 + 2 * found[4] + found[5]
    kind = data[start : start + 4]
    if kind in (b"Xing", b"Info"):
        flags, p = int.from_bytes(data[start + 4 : start + 8], "big"), start + 8
        out = {"kind": kind.decode(), "frames": None, "bytes": None, "toc": b""}
        for flag, name in ((1, "frames"), (2, "bytes")):
            if flags & flag:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"] = data[p : p + MAX_TOC]
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big"), "toc": b""}
    return None


def decode(data: bytes) -> dict:
    """tags, table, offsets (of audio frames), sizes, duration (exact seconds), hz, skipped (bytes), checked and bad
    (frames with a checksum, and with a wrong one).  Bytes that hold no frame give no offsets and duration 0."""
    at, end, tags = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at += 10 + sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True)) + 10 * (data[at + 5] >> 4 & 1)
        tags.append("ID3v2")
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.append("ID3v1")
    offsets, sizes, duration, table, skipped, hz, checks = [], [], Fraction(0), None, 0, 0, []
    samples: dict[int, int] = {}
    others = bad = 0
    first = True
    while at < end:
        found = header(data, at)
        if not found or at + found[2] > end or (first and not _confirmed(data, at, end)):
            here = _sync(data, at + (0 if first else 1), end)
            skipped += here - at
            at, first = here, False
            continue
        first = False
        then = at + found[2]
        if then < end and not header(data, then) and (here := _sync(data, at + 1, end, then)) < then:  # torn: the next frame begins inside
            skipped += here - at
            at = here
            continue
        if not offsets and table is None and (table := _table(data, at, found)):
            at += found[2]
            continue
        family, layer, size, hz, protected, side = found
        if protected and layer == 3:
            checks.append((at, side))
        elif protected:
            others += 1
            bad += _crc_bits(data, at, checked_bits(data, at, found)) != int.from_bytes(data[at + 4 : at + 6], "big")
        offsets.append(at)
        sizes.append(size)
        samples[hz] = samples.get(hz, 0) + SAMPLES[family, layer]
        at += size
    duration = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    raw = np.frombuffer(data, np.uint8)
    for side in {s for _, s in checks}:
        at_all = np.array([a for a, s in checks if s == side])
        rows = raw[at_all[:, None] + np.array([2, 3, *range(6, 6 + side)])]
        bad += int((crc16(rows) != (raw[at_all + 4].astype(np.uint32) << 8 | raw[at_all + 5])).sum())
    return {"tags": tags, "table": table, "offsets": offsets, "sizes": sizes, "duration": duration, "hz": hz, "skipped": skipped, "checked": len(checks) + others, "bad": bad}


def payload_of(data: bytes, offsets: list[int]) -> bytes:
    """What ``encode`` stored, read from its frames."""
    raw = np.frombuffer(data, np.uint8)
    return raw[np.array(offsets, np.int64)[:, None] + np.arange(DATA_AT, DATA_AT + UNIT)].tobytes()


def padded(text: bytes) -> bytes:
    """Bytes 255 behind the text, up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT or (0 if text else UNIT))


def _feature(data: bytes, read: dict) -> str:
    offsets = np.array(read["offsets"], np.int64)
    steps = hashlib.sha256(offsets.tobytes()).hexdigest()[:16]
    table = read["table"] or {"kind": "none", "frames": 0}
    d = read["duration"]
    return f"frames={len(offsets)};seconds={d.numerator}/{d.denominator};hz={read['hz']};tags={'+'.join(read['tags'])};table={table['kind']}:{table['frames']};checked={read['checked']};bad={read['bad']};skipped={read['skipped']};first={offsets[0] if len(offsets) else -1};seek={steps}"


STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every row's text as UTF-8 (null: empty), padded and encoded.  Rows repeat as they do
    in ``docs``; other columns are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, made, sizes, held = 0, [], [], 0

            def out(at: int, made: list, sizes: list, batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

            for text in blobs(batch.column(1)):
                made.append(encode(padded(text)))
                sizes.append(len(text))
                held += len(made[-1])
                if held > 4 << 20:
                    yield out(at, made, sizes)
                    at, made, sizes, held = at + len(made), [], [], 0
            yield out(at, made, sizes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STORED)


def read_texts(stored: DataFrame) -> DataFrame:
    """What the stored streams say when they are read: sizes, digests of payload and stream, and a feature that gives
    frames, exact seconds, rate, tags, table, checksums, skipped bytes and a digest of the seek offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in (x.as_py() for x in batch.column(2)):
                read = decode(data)
                payload = payload_of(data, read["offsets"])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), _feature(data, read)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=[x.split()[0] for x in READ.split(", ")])

    return stored.mapInArrow(run, READ)


def streams(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of ``media`` and a struct ``mpeg`` (seconds double, n_frames, offsets, skipped, checked, bad) of
    the bytes in ``column``; null bytes have no frames.  If ``media`` has a column mpeg, the new one's name gets underscores.
    Repeated rows give a row each, no rows none."""
    name = "mpeg"
    while name in media.columns:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("seconds", pa.float64()), ("n_frames", pa.int64()), ("offsets", pa.list_(pa.int64())), ("skipped", pa.int64()), ("checked", pa.int64()), ("bad", pa.int64())])
        for batch in batches:
            made = []
            for x in batch.column(batch.schema.get_field_index(column)):
                r = decode(x.as_py() or b"")
                made.append({"seconds": float(r["duration"]), "n_frames": len(r["offsets"]), "offsets": r["offsets"], "skipped": r["skipped"], "checked": r["checked"], "bad": r["bad"]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kind)], names=[*batch.schema.names, name])

    found = "seconds double, n_frames long, offsets array<long>, skipped long, checked long, bad long"
    schema = T.StructType([*media.schema.fields, T.StructField(name, T.StructType.fromDDL(found))])
    return media.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: the text stored as MPEG audio in a table of streams, and read back from it.

    Null and empty texts are one block of padding; equal texts, repeated rows too, have equal values; a text of any length is
    one stream.  No rows give no rows."""
    return read_texts(keep(store_texts(docs), "media"))
