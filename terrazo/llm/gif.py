"""GIF columns: decoding of LZW code streams, palettes, disposal and transparency, timed frames, histograms.

parse() reads any GIF87a or GIF89a: global and local palettes, interlace, graphic control blocks
(delay, disposal 0 to 3, transparent index), loop count; compose() shows the frames on the canvas.
encode() writes indexed frames as LZW.

An LZW table grows by one entry a code, so the width of a code follows from its number since the last clear code. Codes are
therefore packed and unpacked as arrays, a run between two clear codes at a time; only the table itself is walked code by code.

Defined cases of the query: a null text is the empty one; 0 bytes are stored as 64 bytes 0; long texts
take as many frames as they need (ROWS lines of 64 samples each); repeated rows give equal values;
an empty table gives an empty one. No rows meet, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .kernels import utf8

WIDTH = 64
#: Lines of a stored frame, at most.
ROWS = 4096
#: Entries of a table, at most.
TABLE = 4096
GREY = bytes(x for i in range(256) for x in (i, i, i))


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # height x width
    palette: bytes | None = None  # local colours
    delay: int = 0  # hundredths of a second
    disposal: int = 0
    transparent: int | None = None
    interlaced: bool = False


def _blocks(stream: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(stream), 255):
        part = stream[i : i + 255]
        out.append(len(part))
        out += part
    out.append(0)
    return bytes(out)


@cache
def _growing(bits: int) -> np.ndarray:
    """Widths of the first TABLE codes after a clear code: the table has an entry more with each code but the first."""
    size = (1 << bits) + 2 + np.maximum(0, np.arange(TABLE) - 1)
    return np.clip(np.frexp(size)[1], bits + 1, 12).astype(np.int64)


def _widths(start: int, n: int, bits: int) -> np.ndarray:
    """Widths of the codes number start to start + n - 1 after a clear code; those of a full table are of 12 bits."""
    early = _growing(bits)[start : start + n]
    return early if len(early) == n else np.concatenate((early, np.full(n - len(early), 12)))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """The codes, least bit first, one after the other."""
    last = np.cumsum(widths)
    bit = np.arange(last[-1]) - np.repeat(last - widths, widths)
    return np.packbits((np.repeat(codes, widths) >> bit & 1).astype(np.uint8), bitorder="little").tobytes()


def lzw_codes(samples: bytes, bits: int = 8) -> bytes:
    """Code stream of samples of so many bits, with tables up to TABLE codes."""
    clear, end = 1 << bits, (1 << bits) + 1
    # Codes are held eight bits up, so that one with the next sample below it is the key of a table entry.
    codes, clears = [clear << 8], [0]
    put, free, full = codes.append, end + 1 << 8, TABLE << 8
    table: dict[int, int] = {}
    get = table.get
    prefix = samples[0] << 8 if samples else None
    for s in samples[1:]:
        key = prefix | s
        code = get(key)
        if code:
            prefix = code
            continue
        put(prefix)
        prefix = s << 8
        if free < full:
            table[key] = free
            free += 256
        else:
            clears.append(len(codes))
            put(clear << 8)
            table, free = {}, end + 1 << 8
            get = table.get
    if prefix is not None:
        put(prefix)
    put(end << 8)
    # A clear code has the width that the code in its place would have; the first one has that of a new table.
    lengths = np.diff([*clears, len(codes)])
    widths = [np.array([bits + 1])] + [w for n in lengths.tolist() for w in (_widths(0, n, bits),)]
    return _pack(np.array(codes, np.int64) >> 8, np.concatenate(widths)[: len(codes)])


class Codes:
    """Reader of a code stream: codes() gives those up to the next clear or end code, and which of both it is."""

    def __init__(self, stream: bytes, bits: int):
        self.data = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
        self.size, self.at, self.bits = 8 * len(stream), 0, bits

    def codes(self) -> tuple[list[int], int]:
        out: list[int] = []
        start, clear = 0, 1 << self.bits
        while True:
            step = min(TABLE, (self.size - self.at) // (self.bits + 1) + 1)
            widths = _widths(start, step, self.bits)
            ends = self.at + np.cumsum(widths)
            n = int(np.searchsorted(ends, self.size, "right"))
            first = ends[:n] - widths[:n]
            byte = first >> 3
            word = self.data[byte] | self.data[byte + 1] << np.uint32(8) | self.data[byte + 2] << np.uint32(16)
            got = (word >> (first & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
            stop = np.flatnonzero((got == clear) | (got == clear + 1))
            if len(stop):
                k = int(stop[0])
                self.at = int(ends[k])
                return out + got[:k].tolist(), int(got[k])
            out += got.tolist()
            if n < step:
                return out, clear + 1
            start, self.at = start + n, int(ends[-1])


def read_codes(stream: bytes, bits: int, count: int) -> np.ndarray:
    """The first count samples of an LZW code stream with so many bits a sample; too short a stream gives fewer."""
    reader, out, had, stop = Codes(stream, bits), [], 0, 1 << bits
    single = [bytes([i]) for i in range(1 << bits)] + [b"", b""]
    while had < count and stop == 1 << bits:
        codes, stop = reader.codes()
        if not codes:
            continue
        table, put = list(single), out.append
        add = table.append
        if codes[0] >= len(table):
            raise ValueError("LZW code out of range")
        previous = table[codes[0]]
        put(previous)
        growing = TABLE - len(table) + 1
        for code in codes[1:growing]:
            try:
                entry = table[code]
            except IndexError:
                if code > len(table):
                    raise ValueError("LZW code out of range") from None
                entry = previous + previous[:1]
            add(previous + entry[:1])
            put(entry)
            previous = entry
        out += [table[code] for code in codes[growing:]]
        had = sum(map(len, out)) if len(out) < 2 * len(codes) else had + sum(map(len, out[-len(codes) :]))
    return np.frombuffer(b"".join(out)[:count], np.uint8)


def encode(width: int, height: int, frames: list[Frame], palette: bytes = GREY, loop: int | None = None) -> bytes:
    """A GIF89a of the frames; palettes of 256 colours, samples of 8 bits."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.ljust(768, b"\0")]
    if loop is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loop) + b"\0")
    for f in frames:
        h, w = f.indices.shape
        flags = (f.disposal << 2) | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, (0x87 if f.palette else 0) | (0x40 if f.interlaced else 0)))
        if f.palette:
            out.append(f.palette.ljust(768, b"\0"))
        lines = f.indices[_interlace(h)] if f.interlaced else f.indices
        samples = np.ascontiguousarray(lines, np.uint8)
        out.append(b"\x08" + _blocks(lzw_codes(samples.tobytes())))
    out.append(b"\x3b")
    return b"".join(out)


def _interlace(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


@dataclass
class Image:
    width: int
    height: int
    palette: bytes | None
    background: int
    loop: int | None
    frames: list[Frame]


def parse(data: bytes) -> Image:
    """The frames as stored: indices, palettes and control values."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        palette, at = data[at : at + size], at + size
    loop, frames, control = None, [], (0, 0, None)

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, index = struct.unpack_from("<BHB", body)
                control = ((f >> 2) & 7, delay, index if f & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                loop = struct.unpack_from("<H", body, 12)[0]
        elif data[at] == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            local = None
            if f & 0x80:
                size = 3 << ((f & 7) + 1)
                local, at = data[at : at + size], at + size
            bits = data[at]
            stream, at = sub_blocks(at + 1)
            got = read_codes(stream, bits, w * h)
            indices = np.zeros(w * h, np.uint8)
            indices[: len(got)] = got
            indices = indices.reshape(h, w)
            if f & 0x40:
                lines = np.empty_like(indices)
                lines[_interlace(h)] = indices
                indices = lines
            frames.append(Frame(left, top, indices, local, control[1], control[0], control[2], bool(f & 0x40)))
            control = (0, 0, None)
        else:
            raise ValueError(f"unknown block {data[at]:#x}")
    return Image(width, height, palette, background, loop, frames)


def _shown(image: Image) -> Iterator[tuple[int, int, np.ndarray]]:
    """compose(), with a canvas that the next frame is drawn on."""
    canvas = np.zeros((image.height, image.width, 4), np.uint8)
    clock = 0
    for f in image.frames:
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = np.frombuffer((f.palette or image.palette or GREY).ljust(768, b"\0")[:768], np.uint8).reshape(256, 3)
        before = canvas.copy() if f.disposal == 3 else None
        h = min(f.indices.shape[0], max(0, image.height - f.top))
        w = min(f.indices.shape[1], max(0, image.width - f.left))
        part = f.indices[:h, :w]
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        if f.transparent is None:
            area[:] = colours[part]
        else:
            seen = part != f.transparent
            area[seen] = colours[part[seen]]
        yield clock, f.delay, canvas
        clock += f.delay
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            canvas = before


def compose(image: Image) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in hundredths of a second, duration, canvas as height x width x RGBA) of each frame shown."""
    return ((start, lasts, canvas.copy()) for start, lasts, canvas in _shown(image))


def histogram(canvas: np.ndarray, bins: int = 4) -> np.ndarray:
    """Counts of opaque pixels by bins**3 colours."""
    level = (np.arange(256) * bins // 256).astype(np.uint16)
    colour = (level[canvas[..., 0]] * bins + level[canvas[..., 1]]) * bins + level[canvas[..., 2]]
    return np.bincount(colour[canvas[..., 3] > 0], minlength=bins**3)


FRAMES = "frame int, start_cs long, duration_cs int, width int, height int, disposal int, histogram array<long>, pixels binary"


def frames_of(df: DataFrame, content: str, key: str) -> DataFrame:
    """A row for each timed frame of the GIFs in column content: key, times, histogram, RGBA pixels.

    What isn't a GIF, or ends within a frame, gives one row with frame -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                try:
                    image = parse(data.as_py() or b"")
                    for i, ((start, lasts, canvas), f) in enumerate(zip(_shown(image), image.frames, strict=True)):
                        rows.append((i, start, lasts, image.width, image.height, f.disposal, histogram(canvas).tolist(), canvas.tobytes()))
                except (ValueError, IndexError, struct.error):
                    rows = [(-1, 0, 0, 0, 0, 0, [], b"")]
                for row in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.schema.field(0).type), *[pa.array([v], t) for v, t in zip(row, types, strict=True)]], names=[key, *names])

    names = [x.split()[0] for x in FRAMES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
    return df.select(key, content).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {FRAMES}")


def store(payload: np.ndarray) -> bytes:
    """A GIF of greys that holds the payload (a multiple of 64 bytes), line by line; each frame is taken off before the next."""
    lines = payload.reshape(-1, WIDTH)
    frames = [Frame(0, 0, lines[i : i + ROWS], delay=10, disposal=2) for i in range(0, len(lines), ROWS)]
    return encode(WIDTH, min(len(lines), ROWS), frames, loop=0)


def feature_of(image: Image) -> str:
    """Size, frames, time, and the colours shown (those of eight levels a channel that occur) summed over the frames."""
    colours, lasts = np.zeros(512, np.int64), 0
    for _, delay, canvas in _shown(image):
        colours += histogram(canvas, 8)
        lasts += delay
    shown = np.flatnonzero(colours)
    return f"{image.width}x{image.height};frames={len(image.frames)};cs={lasts};hist=" + ",".join(f"{c}:{colours[c]}" for c in shown)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = utf8(batch.column(1))
            rows = []
            for i in range(len(offs) - 1):
                n = int(offs[i + 1] - offs[i])
                payload = np.zeros(max(1, -(-n // WIDTH)) * WIDTH, np.uint8)
                payload[:n] = data[offs[i] : offs[i + 1]]
                media = store(payload)
                image = parse(media)
                read = b"".join(f.indices.tobytes() for f in image.frames)
                feature = feature_of(image)
                rows.append((n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    docs = documents(spark, sf_dir)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
