"""Media columns: AVI files of motion JPEG, as bytes in a binary column.

``write_avi`` stores text losslessly as 8-bit samples: every sample is the mean of one 8x8 block of
a grey baseline-JPEG frame (the DC coefficient, quantised by 8, is the sample less 128).  The DC
table gives category s a code of 9 - s bits, so every block takes ten bits in all.
``read_avi`` parses the RIFF tree and its ``idx1`` index (or walks ``movi`` if there is none),
decodes the intra frames (any baseline JPEG; frames whose blocks all take one length are decoded
at once), and cuts shots where the histogram difference of neighbouring frames exceeds a threshold
that adapts to the shot so far.  Its clips are timed rows; ``clip_rows`` explodes them.

Nulls: a null text is an empty one; a null or unreadable media value gives nulls and no clips.
Texts are padded with spaces to a positive multiple of 192 bytes.  Equal texts give equal files.
Other columns are ignored; repeated rows stay.  Nothing is shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import parts, utf8

UNIT = 192  # samples: 24 x 8 blocks
FRAME_UNITS = 16
RATE = 25

# ---------------------------------------------------------------- JPEG tables

_BITS = 10


def _code_table() -> np.ndarray:
    """Ten bits for every DC difference of -255..255: category code, magnitude, end of block."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (9 - s)) - 2 if s < 9 else 0  # 0, 10, 110, ... for s = 8, 7, 6, ...
        extra = d if d > 0 else d + (1 << s) - 1
        out[d + 255] = (code << s | extra) << 1
    return out


_ENCODE = _code_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(width: int, height: int) -> bytes:
    quant = b"\0" + bytes([8]) + bytes([1]) * 63
    frame = struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])
    dc = b"\0" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = b"\x10" + bytes([1] + [0] * 15) + b"\0"
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _encode_frames(samples: np.ndarray) -> list[bytes]:
    """Scans of frames (n, samples), samples a multiple of 192."""
    level = samples.astype(np.int16) - 128
    code = _ENCODE[np.diff(level, axis=1, prepend=np.int16(0)) + 255].astype(np.uint64).reshape(len(samples), -1, 4)
    word = code[..., 0] << np.uint64(30) | code[..., 1] << np.uint64(20) | code[..., 2] << np.uint64(10) | code[..., 3]
    raw = word.astype(">u8").view(np.uint8).reshape(len(samples), -1, 8)[..., 3:]
    return [x.tobytes().replace(b"\xff", b"\xff\0") for x in raw]


# ---------------------------------------------------------------- RIFF


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(name: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(chunks))


def avi_of(text: bytes) -> bytes:
    """The AVI file that holds a text as samples."""
    units = max(1, -(-len(text) // UNIT))
    frames = -(-units // FRAME_UNITS)
    high = -(-units // frames)
    payload = text.ljust(units * UNIT, b" ")
    samples = np.frombuffer(payload.ljust(frames * high * UNIT, b" "), np.uint8).reshape(frames, high * UNIT)
    width, height = 24 * 8, high * 8 * 8
    head = _jpeg_head(width, height)
    pictures = [head + scan + b"\xff\xd9" for scan in _encode_frames(samples)]
    largest = max(map(len, pictures))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, frames, 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    index, at = [], 4
    for p in pictures:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(p)))
        at += 8 + len(p) + (len(p) & 1)
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", picture)))
    body += _list(b"INFO", _chunk(b"ICMT", b"samples=%d" % len(payload)))
    body += _list(b"movi", *[_chunk(b"00dc", p) for p in pictures]) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> tuple[float, int | None, list[bytes]]:
    """Microseconds per frame, the number of stored samples if noted, and the frames in index order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    period, stored, movi, index = 1e6 / RATE, None, None, None
    for name, at, end in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, _ in _chunks(data, at + 4, end):
                if inner == b"avih":
                    period = struct.unpack_from("<I", data, a)[0] or period
        elif name == b"LIST" and data[at : at + 4] == b"INFO":
            for inner, a, b in _chunks(data, at + 4, end):
                if inner == b"ICMT" and data[a:b].startswith(b"samples="):
                    stored = int(data[a + 8 : b].rstrip(b"\0"))
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, end)
        elif name == b"idx1":
            index = (at, end)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        entries = [struct.unpack_from("<4sIII", data, a) for a in range(index[0], index[1] - 15, 16)]
        entries = [x for x in entries if x[0][2:] in (b"dc", b"db")]
        # offsets count from the list's name, or from the start of the file
        base = movi[0] if entries and data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0
        return period, stored, [data[base + x[2] + 8 : base + x[2] + 8 + x[3]] for x in entries]
    frames = [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return period, stored, frames


# ---------------------------------------------------------------- JPEG decoding

# Fixed value: the zigzag order of coefficients.
_ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


class _Picture:
    """The segments of a baseline JPEG."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.restart = 0
        at = 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker in (0xC0, 0xC1):
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xC4:
                while body:
                    count, code, k, table = body[1:17], 0, 17, {}
                    for length in range(1, 17):
                        for _ in range(count[length - 1]):
                            table[(length, code)] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.codes[body[0]] = table
                    body = body[k:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            at += 2 + size
            if marker == 0xDA:
                self.scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.entropy = data[at:]

    def fixed_length(self) -> int:
        """Bits of every block if the tables allow one length only and no AC coefficient, else 0."""
        if len(self.parts) != 1 or self.restart:
            return 0
        tables = self.scan[self.parts[0][0]]
        ends = self.codes[0x10 | tables & 15]
        lengths = {length + s for (length, _), s in self.codes[tables >> 4].items()}
        if len(lengths) != 1 or list(ends.values()) != [0]:
            return 0
        return lengths.pop() + next(iter(ends))[0]


_fixed: dict[bytes, tuple[_Picture, np.ndarray]] = {}


def _fixed_lookup(p: _Picture, bits: int) -> np.ndarray:
    """DC difference by code word, for tables where every block takes ``bits``."""
    tables = p.scan[p.parts[0][0]]
    tail = next(iter(p.codes[0x10 | tables & 15]))[0]
    out = np.zeros(1 << bits, np.int32)
    for (_, code), s in p.codes[tables >> 4].items():
        for extra in range(1 << s):
            value = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            word = (code << s | extra) << tail
            out[word : word + (1 << tail)] = value
    return out


def _read_fixed(p: _Picture, lookup: np.ndarray, scan: bytes, bits: int) -> np.ndarray:
    """Grey levels of all blocks of a frame whose blocks take ``bits`` each."""
    blocks = -(-p.width // 8) * -(-p.height // 8)
    raw = np.frombuffer(scan.replace(b"\xff\0", b"\xff"), np.uint8)
    if bits == _BITS and blocks % 4 == 0:
        five = raw[: blocks * 5 // 4].reshape(-1, 5).astype(np.uint64)
        word = five[:, 0] << np.uint64(32) | five[:, 1] << np.uint64(24) | five[:, 2] << np.uint64(16) | five[:, 3] << np.uint64(8) | five[:, 4]
        code = np.stack([word >> np.uint64(s) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()
    else:
        flat = np.unpackbits(raw)[: blocks * bits].reshape(blocks, bits)
        code = flat @ (1 << np.arange(bits)[::-1])
    dc = np.cumsum(lookup[code.astype(np.int64)]) * int(p.quant[p.parts[0][3]][0])
    return np.clip(np.round(dc / 8.0) + 128, 0, 255).astype(np.uint8)


def _decode_blocks(p: _Picture) -> dict[int, np.ndarray]:
    """Coefficients of every component, (rows, columns, 64) in zigzag order."""
    wide, high = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
    alone = len(p.parts) == 1
    across, down = (-(-p.width // 8), -(-p.height // 8)) if alone else (-(-p.width // (8 * wide)), -(-p.height // (8 * high)))
    out = {c: np.zeros((down * (1 if alone else v), across * (1 if alone else h), 64), np.int64) for c, h, v, _ in p.parts}
    data, at, held, have = p.entropy, 0, 0, 0

    def bit() -> int:
        nonlocal at, held, have
        if not have:
            held, have = (data[at] if at < len(data) else 0), 8
            at += 2 if held == 0xFF and data[at + 1 : at + 2] == b"\0" else 1
        have -= 1
        return held >> have & 1

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bit()
            if (length, code) in table:
                return table[(length, code)]
        raise ValueError("no such code")

    def magnitude(s: int) -> int:
        v = 0
        for _ in range(s):
            v = v << 1 | bit()
        return v if s == 0 or v >> (s - 1) else v - (1 << s) + 1

    last = {c: 0 for c, *_ in p.parts}
    for mcu in range(across * down):
        if p.restart and mcu and mcu % p.restart == 0:
            have = 0
            while not (data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7):
                at += 1
            at += 2
            last = dict.fromkeys(last, 0)
        for c, h, v, _ in p.parts:
            tables = p.scan[c]
            for y in range(1 if alone else v):
                for x in range(1 if alone else h):
                    block = out[c][mcu // across * (1 if alone else v) + y, mcu % across * (1 if alone else h) + x]
                    last[c] += magnitude(symbol(p.codes[tables >> 4]))
                    block[0] = last[c]
                    k = 1
                    while k < 64:
                        rs = symbol(p.codes[0x10 | tables & 15])
                        if not rs & 15:
                            if rs != 0xF0:
                                break
                            k += 16
                            continue
                        k += rs >> 4
                        block[k] = magnitude(rs & 15)
                        k += 1
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """(height, width, components) levels; components are scaled to the full size, not converted."""
    p = _Picture(data)
    planes = []
    wide, high = max(x[1] for x in p.parts), max(x[2] for x in p.parts)
    for c, blocks in _decode_blocks(p).items():
        _, h, v, q = next(x for x in p.parts if x[0] == c)
        plain = np.zeros(blocks.shape, np.float64)
        plain[..., _ZIGZAG] = blocks * p.quant[q]
        square = _BASIS.T @ plain.reshape(*blocks.shape[:2], 8, 8) @ _BASIS
        plane = np.clip(np.round(square + 128), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
        if len(p.parts) > 1:
            plane = plane.repeat(high // v, 0).repeat(wide // h, 1)
        planes.append(plane[: p.height, : p.width])
    return np.stack(planes, axis=2)


def frame_samples(data: bytes) -> np.ndarray:
    """The mean level of every 8x8 block of a frame's first component, in row order."""
    at = data.find(b"\xff\xda")
    head = data[: at + 10]
    if head not in _fixed and len(_fixed) < 256:
        p = _Picture(data)
        bits = p.fixed_length()
        _fixed[head] = (p, _fixed_lookup(p, bits) if bits else np.zeros(0, np.int32), bits)
    if head in _fixed and _fixed[head][2]:
        p, lookup, bits = _fixed[head]
        return _read_fixed(p, lookup, data[at + 10 : len(data) - 2], bits)
    plane = decode_jpeg(data)[..., 0].astype(np.float64)
    high, wide = -(-plane.shape[0] // 8), -(-plane.shape[1] // 8)
    plane = np.pad(plane, ((0, high * 8 - plane.shape[0]), (0, wide * 8 - plane.shape[1])), mode="edge")
    return np.round(plane.reshape(high, 8, wide, 8).mean(axis=(1, 3))).astype(np.uint8).ravel()


# ---------------------------------------------------------------- shots


def shot_starts(frames: list[np.ndarray], spread: float = 3.0, least: float = 0.15) -> list[int]:
    """First frames of shots.  A frame starts one if its 16-bin histogram differs from the last by
    more than ``least`` and more than mean + spread * deviation of the shot's differences so far."""
    starts, seen, before = [0] if frames else [], [], None
    for i, samples in enumerate(frames):
        histogram = np.bincount(samples >> 4, minlength=16) / max(len(samples), 1)
        if before is not None:
            d = 0.5 * float(np.abs(histogram - before).sum())
            limit = float(np.mean(seen) + spread * np.std(seen)) if len(seen) >= 2 else least
            if d > max(least, limit):
                starts.append(i)
                seen = []
            else:
                seen.append(d)
        before = histogram
    return starts


def read_file(data: bytes) -> tuple[bytes, list[dict]]:
    """The stored samples and the clips of an AVI file."""
    period, stored, pictures = parse_avi(data)
    frames = [frame_samples(p) for p in pictures]
    starts = shot_starts(frames)
    payload = b"".join(f.tobytes() for f in frames)
    clips = []
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(frames)], strict=True)):
        level = np.concatenate(frames[a:b])
        clips.append({"clip": i, "first_frame": a, "frames": b - a, "start_ms": round(a * period / 1000), "end_ms": round(b * period / 1000), "level": float(level.mean())})
    return payload if stored is None else payload[:stored], clips


# ---------------------------------------------------------------- columns


def write_avi(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in parts(whole, 256)):
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([avi_of(t) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_CLIP = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("level", pa.float64())]))


def read_avi(files: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``media``, ``payload`` (the samples read back) and ``clips``."""
    kept = files.select(*keep, "media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    schema += ", payload binary, clips array<struct<clip:int,first_frame:int,frames:int,start_ms:long,end_ms:long,level:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                payload, clips = [], []
                for data in part.column(part.num_columns - 1).to_pylist():
                    try:
                        found = read_file(data or b"")
                    except (ValueError, IndexError, KeyError, AttributeError, struct.error):
                        found = (None, [])
                    payload.append(found[0])
                    clips.append(found[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(clips, _CLIP)], [*part.schema.names, "payload", "clips"])

    return kept.mapInArrow(run, schema)


def clip_rows(read: DataFrame, keep: list[str]) -> DataFrame:
    """One row per clip: the ``keep`` columns and the clip's fields."""
    return read.select(*keep, F.explode("clips").alias("c")).select(*keep, "c.*")
