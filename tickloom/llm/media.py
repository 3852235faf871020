"""AVI motion-JPEG files in a binary column: written without loss from bytes, read back, cut into timed clips.

A byte is one quantised DCT coefficient, the unit that baseline JPEG keeps without loss: the 8-bit magnitudes of
category 8 (-255..-128 and 128..255) are just the 256 bytes, and the extra bits that follow the category's code are
the byte itself. A block of 8 by 8 has 64 of them, an interleaved unit of three components 192. Restart markers
after every unit reset the DC prediction. The reader parses the RIFF index, the tables of every frame and its scan;
scans whose tables hold this one category decode as arrays, all others by a general baseline decoder.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.textio import per_text

UNIT = 192
#: units stacked in one frame; the last frame of a file may have fewer
FRAME_UNITS = 16
FRAME_MICROS = 40_000
#: shots: a frame differs when its histogram distance passes mean + DEVIATIONS * std of the last WINDOW distances
WINDOW, DEVIATIONS, LEAST_DISTANCE, BINS = 12, 3.0, 0.15, 16

#: fixed values of the JPEG standard: the zigzag order of the 8 by 8 coefficients follows from a rule
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _dct_basis() -> np.ndarray:
    """Pixels of a block from its coefficients in zigzag order, as a 64 by 64 matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


_BASIS = _dct_basis()

# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_code_table(kind: int, symbol: int) -> bytes:
    """Huffman table with one code, the bit 0."""
    return bytes([kind, 1, *[0] * 15, symbol])


def _frame_head(units: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8 * units, 8, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    huff = _segment(0xC4, _one_code_table(0x00, 8) + _one_code_table(0x10, 8))
    restart = _segment(0xDD, struct.pack(">H", 1))
    scan = _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + huff + restart + scan


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def padded(data: bytes) -> bytes:
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a positive multiple of 192 bytes."""
    bits = np.unpackbits(np.frombuffer(payload, np.uint8)).reshape(-1, 8)
    coded = np.zeros((len(bits), 9), np.uint8)
    coded[:, 1:] = bits
    coded = np.packbits(coded)  # 216 bytes a unit
    units = [coded[i : i + 216].tobytes().replace(b"\xff", b"\xff\0") for i in range(0, len(coded), 216)]
    frames = []
    for i in range(0, len(units), FRAME_UNITS):
        own = units[i : i + FRAME_UNITS]
        scan = b"".join(u + bytes([0xFF, 0xD0 + k % 8]) for k, u in enumerate(own[:-1])) + own[-1]
        frames.append(_frame_head(len(own)) + scan + b"\xff\xd9")
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    high = 8 * min(FRAME_UNITS, len(units))
    main = struct.pack("<14I", FRAME_MICROS, 0, 0, 0x10, len(frames), 0, 1, 0, 8, high, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I", 0, 0, 0, FRAME_MICROS, 1_000_000, 0, len(frames), 0, 0xFFFFFFFF, 0) + struct.pack("<4H", 0, 0, 8, high)
    form = struct.pack("<IIIHH4sIIIII", 40, 8, high, 1, 24, b"MJPG", 8 * high * 3, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


# ---------------------------------------------------------------- reading


class Avi(NamedTuple):
    frame_micros: int
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> Avi:
    """Frames of the first video stream by the file's index, or in file order where it has none.

    Raises ValueError for anything that is not an AVI file. Index offsets may count from the movi list or the file.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    micros, movi, index = FRAME_MICROS, None, None
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, _ in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    micros = struct.unpack_from("<I", data, a)[0]
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, at + size)
        elif name == b"idx1":
            index = (at, size)
    if movi is None:
        raise ValueError("no movi list")
    if index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * i) for i in range(index[1] // 16)]
        video = [e for e in entries if e[0][2:] in (b"dc", b"db")]
        base = movi[0] if video and data[movi[0] + video[0][2] : movi[0] + video[0][2] + 4] == video[0][0] else 0
        frames = [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in video]
    else:
        frames = [data[at : at + size] for name, at, size in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    return Avi(micros, frames)


class Jpeg(NamedTuple):
    height: int
    width: int
    sampling: list[tuple[int, int]]  # of each component
    quant: list[np.ndarray]
    huffman: list[tuple[dict, dict]]  # DC and AC codes of each component: (length, code) -> symbol
    restart: int
    scan: bytes
    head: bytes  # all before the scan

    @property
    def direct(self) -> bool:
        """Every coefficient is one bit of code and eight of the byte, in units of one block for each component."""
        return self.restart == 1 and all(t == _SINGLE for pair in self.huffman for t in pair) and all(s == (1, 1) for s in self.sampling)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse_frames(frames: list[bytes]) -> list[Jpeg]:
    """Headers that repeat from frame to frame are parsed once."""
    out: list[Jpeg] = []
    for f in frames:
        if out and f.startswith(out[-1].head):
            out.append(out[-1]._replace(scan=_scan(f, len(out[-1].head))))
        else:
            out.append(parse_jpeg(f))
    return out


def _scan(data: bytes, at: int) -> bytes:
    end = data.rfind(b"\xff\xd9")
    return data[at : end if end > 0 else len(data)]


def parse_jpeg(data: bytes) -> Jpeg:
    at, quant, tables, restart, frame = 2, {}, {}, 0, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            high, wide, n = struct.unpack_from(">HHB", body, 1)
            frame = (high, wide, [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)])
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            parts = frame[2]
            return Jpeg(frame[0], frame[1], [(s >> 4, s & 15) for _, s, _ in parts], [quant[q] for _, _, q in parts], [(tables[chosen[c] >> 4], tables[0x10 | chosen[c] & 15]) for c, _, _ in parts], restart, _scan(data, at), data[:at])


_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")
_SINGLE = {(1, 0): 8}


def _parts(j: Jpeg) -> list[bytes]:
    return [p.replace(b"\xff\0", b"\xff") for p in (_RESTARTS.split(j.scan) if j.restart else [j.scan])]


def coefficients(frames: list[Jpeg]) -> list[np.ndarray]:
    """Quantised coefficients of each frame in zigzag order, a row for each block in the order of the scan."""
    if not all(j.direct for j in frames):
        return [_general(j, _parts(j)) for j in frames]
    out, parts = [], [_parts(j) for j in frames]
    for j, own in zip(frames, parts):
        if any(len(p) != 72 * len(j.sampling) for p in own):
            raise ValueError("broken scan")
    raw = np.packbits(np.unpackbits(np.frombuffer(b"".join(p for own in parts for p in own), np.uint8)).reshape(-1, 9)[:, 1:]).astype(np.int16)
    blocks = np.where(raw < 128, raw - 255, raw).reshape(-1, 64)
    at = np.cumsum([0] + [len(own) * len(j.sampling) for j, own in zip(frames, parts)])
    for a, b in zip(at[:-1], at[1:]):
        out.append(blocks[a:b])
    return out


def _general(j: Jpeg, parts: list[bytes]) -> np.ndarray:
    """Any baseline scan, code by code."""
    order = [c for c, (h, v) in enumerate(j.sampling) for _ in range(h * v)]
    top_h, top_v = max(h for h, _ in j.sampling), max(v for _, v in j.sampling)
    left = -(-j.width // (8 * top_h)) * -(-j.height // (8 * top_v))
    out = []
    for part in parts:
        bits, at = np.unpackbits(np.frombuffer(part, np.uint8)).tolist(), 0
        last = [0] * len(j.sampling)

        def code(table):
            nonlocal at
            value = 0
            for length in range(1, 17):
                value = value << 1 | bits[at]
                at += 1
                if (length, value) in table:
                    return table[length, value]
            raise ValueError("broken scan")

        def number(size):
            nonlocal at
            value = int("".join(map(str, bits[at : at + size])) or "0", 2)
            at += size
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for _ in range(min(left, j.restart or left)):
            left -= 1
            for c in order:
                dc, ac = j.huffman[c]
                block = [0] * 64
                last[c] += number(code(dc))
                block[0], k = last[c], 1
                while k < 64:
                    symbol = code(ac)
                    if not symbol & 15 and symbol != 0xF0:
                        break
                    k += symbol >> 4
                    if symbol & 15:
                        block[k] = number(symbol & 15)
                    k += 1
                out.append(block)
    return np.array(out, np.int32).reshape(-1, 64)


def payload_of(blocks: np.ndarray) -> bytes:
    return np.where(blocks < 0, blocks + 255, blocks).astype(np.uint8).tobytes()


def histograms(frames: list[Jpeg], blocks: list[np.ndarray]) -> np.ndarray:
    """Share of each frame's decoded samples in each of BINS ranges of brightness, for up to three components."""
    scaled, cell = [], []
    for k, (j, own) in enumerate(zip(frames, blocks)):
        order = [c for c, (h, v) in enumerate(j.sampling) for _ in range(h * v)]
        part = np.tile(order, -(-len(own) // len(order)))[: len(own)]
        flat = all((q == 1).all() for q in j.quant)
        scaled.append(own if flat else own * np.stack(j.quant)[part])
        cell.append((3 * k + part) * BINS)
    pixels = np.clip(np.concatenate(scaled).astype(np.float32) @ _BASIS + 128, 0, 255).astype(np.uint8) // (256 // BINS)
    counts = np.bincount((pixels + np.concatenate(cell)[:, None]).ravel(), minlength=3 * BINS * len(frames)).reshape(len(frames), -1)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def shots(histograms: np.ndarray) -> list[tuple[int, int, float]]:
    """First frame, frame after the last, and the distance at the cut that begins each shot."""
    distance = np.abs(np.diff(histograms, axis=0)).sum(axis=1)
    cuts = [(0, 0.0)]
    for i, d in enumerate(distance):
        past = distance[max(0, i - WINDOW) : i]
        if d >= LEAST_DISTANCE and len(past) >= 3 and d > past.mean() + DEVIATIONS * past.std():
            cuts.append((i + 1, float(d)))
    stops = [c for c, _ in cuts[1:]] + [len(histograms)]
    return [(a, b, d) for (a, d), b in zip(cuts, stops)]


class Decoded(NamedTuple):
    payload: bytes
    clips: list[tuple[int, int, float]]
    micros: int


def decode(media: bytes) -> Decoded:
    avi = read_avi(media)
    if not avi.frames:
        return Decoded(b"", [], avi.frame_micros)
    frames = parse_frames(avi.frames)
    blocks = coefficients(frames)
    return Decoded(payload_of(np.concatenate(blocks)), shots(histograms(frames, blocks)), avi.frame_micros)


# ---------------------------------------------------------------- columns


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: every row's text (null: empty) as an AVI file."""

    def write(texts):
        return [pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([write_avi(padded(t or b"")) for t in texts], pa.binary())]

    return per_text(docs.select(id_col, text_col), "n_bytes long, media binary", write)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each shot: id, clip, start_ms, end_ms, first_frame, n_frames, distance. Rows that are no AVI file give none."""
    kind = "array<struct<clip:int,start_ms:double,end_ms:double,first_frame:int,n_frames:int,distance:double>>"

    def read(files):
        out = []
        for f in files:
            try:
                d = decode(f or b"")
            except (ValueError, IndexError, KeyError, TypeError, struct.error):
                out.append([])
                continue
            out.append([{"clip": k, "start_ms": a * d.micros / 1000, "end_ms": b * d.micros / 1000, "first_frame": a, "n_frames": b - a, "distance": x} for k, (a, b, x) in enumerate(d.clips)])
        typed = pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("distance", pa.float64())]))
        return [pa.array(out, typed)]

    return per_text(media.select(id_col, media_col), f"clips {kind}", read).select(id_col, F.explode("clips").alias("c")).select(id_col, "c.*")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_bytes and the digests of what is read back from the stored files, with their clips as text."""

    def read(files):
        rows = []
        for f in files:
            d = decode(f)
            feature = ";".join(f"{a}-{b}@{a * d.micros // 1000}-{b * d.micros // 1000}ms:{x:.4f}" for a, b, x in d.clips)
            rows.append((len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return [pa.array(c, k) for c, k in zip(cols, kinds)]

    ordered = media.select(F.struct(id_col, "n_bytes").alias("key"), "media")
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return per_text(ordered, schema, read).select("key.*", *[c.split()[0] for c in schema.split(", ")])
