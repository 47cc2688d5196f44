"""MPEG audio columns: frames written from bytes, and any stream parsed.

The parser resynchronises on frame headers (a header counts when the next one
stands where its length says, or the stream ends there), steps over ID3v2,
ID3v1 and APE tags, reads Xing, Info and VBRI tables, verifies the CRC-16 of
protected Layer III frames and of free bytes between frames, and gives exact
durations (samples over rate, as integers) and the byte offset of every frame.

The writer keeps a payload in MPEG-1 Layer III frames of 48 kHz, 224 kbit/s,
stereo, with checksums. Every frame holds 576 payload bytes as ancillary data
behind an empty side information, so that a decoder plays silence. An ID3v2
tag and an Info frame with counts and a seek table go first, an ID3v1 tag
last.

Defined results: null is the empty payload, which is padded to one frame;
bytes without any frame give 0 frames, a null rate and an empty offset list;
a cut last frame is not counted and shows in ``skipped_bytes``; repeated rows are
stored each, equal texts equally; an empty table gives no rows; a long text is one
stream, held in its task alone; columns of any name pass through, but for those
named like the results, which these replace.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import documents, lean, small_batches

UNIT = 576  # payload bytes in a frame
PAD = 255
FRAME, HEAD = 672, 38  # bytes of a frame; of header, checksum and side information

# Fixed values of the standard: kbit/s by (version is 1, layer), and Hz.
RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = (44100, 48000, 32000)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 with polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ CRC_TABLE[crc >> 8 ^ byte]
    return crc


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        table.append(crc)
    return table


CRC_TABLE = _crc_table()


def header(word: bytes) -> dict | None:
    """The fields of a 4-byte frame header, or None. Free format is refused,
    as its frame length isn't in the header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate, hertz = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3 or word[3] & 3 == 2:
        return None
    first = version == 3
    bits = RATES[first, layer][rate] * 1000
    hz = HERTZ[hertz] >> (0 if first else 1 if version == 2 else 2)
    padding = word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    length = (12 * bits // hz + padding) * 4 if layer == 1 else samples // 8 * bits // hz + padding
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return {
        "version": {3: 1.0, 2: 2.0, 0: 2.5}[version], "layer": layer, "protected": not word[1] & 1, "bits": bits, "hz": hz,
        "length": length, "samples": samples, "mono": mono, "side": side, "key": (version, layer, hz),
    }


def tags(data: bytes) -> tuple[int, int, list[str]]:
    """Where the frames begin and end, and the tags around them."""
    at, end, found = 0, len(data), []
    while data[at : at + 3] == b"ID3" and at + 10 <= end and max(data[at + 6 : at + 10]) < 128:
        size = sum(b << 7 * (3 - i) for i, b in enumerate(data[at + 6 : at + 10]))
        found.append(f"ID3v2.{data[at + 3]}")
        at = min(end, at + 10 + size + (10 if data[at + 5] & 16 else 0))
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        found.append("ID3v1")
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = struct.unpack("<I", data[end - 20 : end - 16])[0]
        if size <= end - at:
            end -= size + (32 if data[end - 9] & 128 and size + 32 <= end - at else 0)
            found.append("APE")
    return at, end, found


def vbr_table(frame: bytes, h: dict) -> dict | None:
    """A Xing, Info or VBRI table in a frame."""
    at = 4 + 2 * h["protected"] + h["side"]
    for start in dict.fromkeys((at, 4 + h["side"])):
        kind = frame[start : start + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= start + 8:
            flags, at, out = struct.unpack(">I", frame[start + 4 : start + 8])[0], start + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit and len(frame) >= at + 4:
                    out[name] = struct.unpack(">I", frame[at : at + 4])[0]
                    at += 4
            if flags & 4 and len(frame) >= at + 100:
                out["toc"] = list(frame[at : at + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, step = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)] if width in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "step": step, "toc": toc}
    return None


def checksum_ok(frame: bytes, h: dict) -> bool | None:
    """Of a protected Layer III frame; None for others (the bits that other
    layers protect depend on their allocation tables)."""
    if not h["protected"] or h["layer"] != 3:
        return None
    known = CRC_SEEN.get(covered := frame[2:4] + frame[6 : 6 + h["side"]])
    if known is None:
        known = crc16(covered)
        if len(CRC_SEEN) < 4096:
            CRC_SEEN[covered] = known
    return known == frame[4] << 8 | frame[5]


CRC_SEEN: dict[bytes, int] = {}


def parse(data: bytes) -> dict:
    """Frames, tags, tables, checksums, exact duration and seek offsets."""
    at, end, found = tags(data)
    out = {"tags": found, "vbr": None, "offsets": [], "samples": 0, "hz": None, "crc_ok": 0, "crc_bad": 0, "skipped_bytes": 0, "bit_rates": set()}
    key = None
    heads: dict[bytes, dict | None] = {}
    while at + 4 <= end:
        word = data[at : at + 4]
        if word not in heads:
            heads[word] = header(word)
        h = heads[word]
        ok = h is not None and (key is None or h["key"] == key) and at + h["length"] <= end
        if ok and at + h["length"] + 4 <= end:
            follows = data[at + h["length"] : at + h["length"] + 4]
            if follows not in heads:
                heads[follows] = header(follows)
            n = heads[follows]
            # after a break in the stream a frame of the known kind may stand alone
            ok = n is not None and n["key"] == h["key"] or key is not None and checksum_ok(data[at : at + h["length"]], h) is True
        if not ok:
            on = data.find(b"\xff", at + 1, end)
            on = end if on < 0 else on
            out["skipped_bytes"] += on - at
            at = on
            continue
        frame = data[at : at + h["length"]]
        if key is None:
            key, out["hz"] = h["key"], h["hz"]
            if (table := vbr_table(frame, h)) is not None:
                out["vbr"] = table
                at += h["length"]
                continue
        good = checksum_ok(frame, h)
        out["crc_ok"] += good is True
        out["crc_bad"] += good is False
        out["offsets"].append(at)
        out["samples"] += h["samples"]
        out["bit_rates"].add(h["bits"])
        at += h["length"]
    out["skipped_bytes"] += max(0, end - at)
    return out


def _head() -> bytes:
    word = bytes([0xFF, 0xFA, 12 << 4 | 1 << 2, 0])
    return word + crc16(word[2:4] + bytes(32)).to_bytes(2, "big") + bytes(32)


def encode(payload: bytes) -> bytes:
    """``payload``, a multiple of 576 bytes, as a stream of frames."""
    n, rest = divmod(len(payload), UNIT)
    if rest or not n:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    frames = np.zeros((n + 1, FRAME), np.uint8)
    frames[:, :HEAD] = np.frombuffer(_head(), np.uint8)
    frames[1:, HEAD : HEAD + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    toc = bytes(i * 256 // 100 for i in range(100))
    table = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    frames[0, HEAD : HEAD + len(table)] = np.frombuffer(table, np.uint8)
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    field = b"TXXX" + bytes(len(text) >> 7 * (3 - i) & 127 for i in range(4)) + b"\0\0" + text
    tag = b"ID3\x04\x00\x00" + bytes(len(field) >> 7 * (3 - i) & 127 for i in range(4)) + field
    # A true ID3v1 tag closes the stream, so that no payload can look like one.
    return tag + frames.tobytes() + b"TAG" + bytes(125)


def decode(media: bytes, found: dict | None = None) -> bytes:
    """The payload of a stream that ``encode`` wrote, from its parsed frames."""
    found = parse(media) if found is None else found
    offsets = np.asarray(found["offsets"], np.int64)
    if not len(offsets):
        return b""
    data = np.frombuffer(media, np.uint8)
    return data[offsets[:, None] + np.arange(HEAD, HEAD + UNIT)].tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes([PAD]) * (-len(text) % UNIT or UNIT * (not text))


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("payload").to_pylist()
        media = pa.array([encode(padded(x or b"")) for x in texts], pa.binary())
        names = [c for c in batch.schema.names if c != "payload"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(x or b"") for x in texts], pa.int64()), media], [*names, "n_bytes", "media"])


def store_as_audio(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_bytes`` (unpadded) and ``media``: the bytes of
    ``column`` as an MPEG stream."""
    small_batches(df.sparkSession)
    keep = [c for c in keep if c not in ("n_bytes", "media")]
    rows = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(column).cast("binary").alias("payload"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "payload")
    return rows.mapInArrow(lean(_encode_batches), f"{schema}n_bytes long, media binary").toDF(*keep, "n_bytes", "media")


PARSED = (
    "frames long, samples long, hz int, duration_us long, tags array<string>, vbr_kind string, vbr_frames long, "
    "crc_ok long, crc_bad long, skipped_bytes long, seek_offsets array<long>, payload binary"
)


def _row(media: bytes | None) -> tuple:
    p = parse(media or b"")
    vbr = p["vbr"] or {}
    us = p["samples"] * 1_000_000 // p["hz"] if p["hz"] else 0
    return len(p["offsets"]), p["samples"], p["hz"], us, p["tags"], vbr.get("kind"), vbr.get("frames"), p["crc_ok"], p["crc_bad"], p["skipped_bytes"], p["offsets"], decode(media or b"", p)


TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())


def parse_audio(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with the fields of ``PARSED`` for the streams in ``column``."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*map(_row, batch.column(column).to_pylist()), strict=True)) or [()] * len(names)
            more = [pa.array(x, t) for x, t in zip(rows, TYPES, strict=True)]
            keep = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in names)
    small_batches(df.sparkSession)
    return df.mapInArrow(lean(run), f"{schema}, {PARSED}")


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            p = parse(media)
            payload = decode(media, p)
            seek = hashlib.sha256(np.asarray(p["offsets"], ">i8").tobytes()).hexdigest()[:16]
            feature = (
                f"frames={len(p['offsets'])};samples={p['samples']};hz={p['hz']};table={p['vbr']['kind']}:{p['vbr']['frames']};"
                f"tags={'+'.join(p['tags'])};crc_ok={p['crc_ok']};crc_bad={p['crc_bad']};skipped={p['skipped_bytes']};"
                f"first={p['offsets'][0]};last={p['offsets'][-1]};seek={seek}"
            )
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_bytes", *(x.split()[0] for x in DIGEST.split(", "))],
        )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_as_audio(documents(spark, sf_dir), "text", ["doc_id"])
    return stored.mapInArrow(lean(_digest), f"doc_id long, n_bytes long, {DIGEST}")
