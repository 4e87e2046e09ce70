"""Binary files landed as (path, content), as Spark's binaryFile source gives them: shapefiles, GeoTIFF, complex rasters, sheets.

A file is decoded in the task that read it. Multi-part rasters leave row by row chunks, so a worker holds one file and one chunk.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and content of the files under path whose names fit the pattern."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


# --- shapefiles (ESRI's published format)


def polygon_records(content: bytes) -> Iterator[tuple[int, list]]:
    """Record number from 0 and rings of each shape of an .shp; null shapes have no rings."""
    at, number = 100, 0
    while at + 12 <= len(content):
        (words,) = struct.unpack(">i", content[at + 4 : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        (kind,) = struct.unpack("<i", body[:4])
        rings = []
        if kind in (3, 5, 13, 15, 23, 25):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2)
            rings = [xy[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        yield number, rings
        at, number = at + 8 + 2 * words, number + 1


def attribute_records(content: bytes, encoding: str = "utf-8") -> Iterator[tuple[int, dict]]:
    """Record number from 0 and trimmed attributes (null where blank) of each row of a .dbf."""
    rows, head, width = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 0x0D:
        fields.append((content[at : at + 11].split(b"\0")[0].decode("ascii"), content[at + 16]))
        at += 32
    for n in range(rows):
        row, at, out = content[head + n * width : head + (n + 1) * width], 1, {}
        for name, size in fields:
            out[name] = row[at : at + size].decode(encoding, "replace").strip(" \0") or None
            at += size
        yield n, out


def read_shapefiles(files: DataFrame) -> DataFrame:
    """stem, record, rings, attributes of the polygons in .shp files, with the rows of the .dbf of the same stem if there is one."""
    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, content in zip(b["stem"], b["content"]):
                yield pd.DataFrame([(stem, n, rings) for n, rings in polygon_records(content)], columns=["stem", "record", "rings"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, content in zip(b["stem"], b["content"]):
                yield pd.DataFrame([(stem, n, a) for n, a in attribute_records(content)], columns=["stem", "record", "attributes"])

    d = files.select(F.regexp_extract("path", r"(?s)^(.*)\.[^./]*$", 1).alias("stem"), F.lower(F.substring_index("path", ".", -1)).alias("kind"), "content")
    s = d.where("kind = 'shp'").select("stem", "content").mapInPandas(shapes, "stem string, record int, rings array<array<array<double>>>")
    a = d.where("kind = 'dbf'").select("stem", "content").mapInPandas(rows, "stem string, record int, attributes map<string,string>")
    return s.join(a, ["stem", "record"], "left")


def shapefile_bytes(shapes: list[list]) -> bytes:
    """An .shp of polygons, each a list of closed rings of points; without rings a null shape."""
    out, box = [], [np.inf, np.inf, -np.inf, -np.inf]
    for n, rings in enumerate(shapes, 1):
        body = struct.pack("<i", 0)
        if len(rings):
            xy = np.array([tuple(p) for r in rings for p in r], "<f8")
            lo, hi = xy.min(0), xy.max(0)
            box = [min(box[0], lo[0]), min(box[1], lo[1]), max(box[2], hi[0]), max(box[3], hi[1])]
            starts = np.cumsum([0, *[len(r) for r in rings[:-1]]]).astype("<i4")
            body = struct.pack("<i4d2i", 5, *lo, *hi, len(rings), len(xy)) + starts.tobytes() + xy.tobytes()
        out.append(struct.pack(">2i", n, len(body) // 2) + body)
    rest = b"".join(out)
    box = box if np.isfinite(box).all() else [0.0] * 4
    return struct.pack(">i20xi", 9994, 50 + len(rest) // 2) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0) + rest


# --- rasters

_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_TIFF_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


def tiff_tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the tags of a TIFF's first image."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    if struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    (at,) = struct.unpack(order + "I", content[4:8])
    (n,) = struct.unpack(order + "H", content[at : at + 2])
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        size, place = _TIFF_SIZES.get(kind, 1) * count, at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack(order + "I", content[place : place + 4])
        raw = content[place : place + size]
        tags[tag] = struct.unpack(f"{order}{count}{_TIFF_CODES[kind]}", raw) if kind in _TIFF_CODES else (raw.rstrip(b"\0").decode("latin-1"),)
    return order, tags


def tiff_blocks(content: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, first column and values (of the first band) of each strip or tile; plain or deflated, without predictor."""
    order, t = tiff_tags(content)
    width, height, bands = t[256][0], t[257][0], t.get(277, (1,))[0]
    if t.get(259, (1,))[0] not in (1, 8, 32946) or t.get(317, (1,))[0] != 1:
        raise ValueError("only plain or deflated blocks without predictor are read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[t.get(339, (1,))[0]]}{t[258][0] // 8}")
    tiled = 322 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    inner = bands if t.get(284, (1,))[0] == 1 else 1
    across, down = -(-width // bw), -(-height // bh)
    starts, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    for k in range(across * down):
        raw = content[starts[k] : starts[k] + sizes[k]]
        raw = zlib.decompress(raw) if t.get(259, (1,))[0] != 1 else raw
        block = np.frombuffer(raw, kind)
        block = block.reshape(-1, bw, inner)[:, :, 0]
        r, c = k // across * bh, k % across * bw
        yield r, c, block[: height - r, : width - c]


def tiff_bytes(a: np.ndarray, rows: int = 64, scale: tuple[float, float] | None = None, corner: tuple[float, float] | None = None, nodata: str | None = None) -> bytes:
    """A one-band TIFF of deflated strips, with pixel scale, corner and nodata as geographic tags."""
    a = np.ascontiguousarray(a)
    little = a.astype(a.dtype.newbyteorder("<"))
    strips = [zlib.compress(little[r : r + rows].tobytes()) for r in range(0, len(a), rows)]
    tags: list[tuple[int, str, tuple]] = [
        (256, "I", (a.shape[1],)), (257, "I", (a.shape[0],)), (258, "H", (a.dtype.itemsize * 8,)), (259, "H", (8,)), (262, "H", (1,)), (273, "I", ()), (277, "H", (1,)), (278, "I", (rows,)),
        (279, "I", tuple(map(len, strips))), (339, "H", ({"u": 1, "i": 2, "f": 3}[a.dtype.kind],)),
    ]
    if scale and corner:
        tags += [(33550, "d", (*scale, 0.0)), (33922, "d", (0.0, 0.0, 0.0, *corner, 0.0))]
    if nodata is not None:
        tags.append((42113, "s", (nodata.encode() + b"\0",)))
    at, starts = 8, []
    for s in strips:
        starts.append(at)
        at += len(s)
    tags = [(t, c, tuple(starts)) if t == 273 else (t, c, v) for t, c, v in tags]
    extra = at + 2 + 12 * len(tags) + 4
    head, rest = struct.pack("<H", len(tags)), b""
    for t, c, v in tags:
        raw = v[0] if c == "s" else struct.pack(f"<{len(v)}{c}", *v)
        head += struct.pack("<HHI", t, {"H": 3, "I": 4, "d": 12, "s": 2}[c], len(raw) if c == "s" else len(v))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra + len(rest))
            rest += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + head + b"\0" * 4 + rest


def read_rasters(files: DataFrame) -> DataFrame:
    """path, row, col, value of the first band of TIFF files; nodata and NaN are null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                none = tiff_tags(content)[1].get(42113)
                for r, c, block in tiff_blocks(content):
                    v = block.astype(float)
                    if none:
                        v[v == float(none[0])] = np.nan
                    rows, cols = np.indices(v.shape)
                    yield pd.DataFrame({"path": path, "row": rows.ravel() + r, "col": cols.ravel() + c, "value": pd.array(np.where(np.isnan(v), None, v).ravel(), "Float64")})

    return files.select("path", "content").mapInPandas(run, "path string, row long, col long, value double")


def raster_info(files: DataFrame) -> DataFrame:
    """path, width, height, pixel sizes, left and top of TIFF files (null without geographic tags)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                t = tiff_tags(content)[1]
                s, c = t.get(33550, (None,) * 3), t.get(33922, (None,) * 6)
                rows.append((path, t[256][0], t[257][0], s[0], s[1], c[3], c[4]))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "dx", "dy", "left", "top"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, dx double, dy double, left double, top double")


def write_rasters(cells: DataFrame, size: float = 1.0) -> DataFrame:
    """cells: path, row, col, value. path and content of one GeoTIFF for each path (NaN where no cell is); a path's cells are one task's."""
    def run(b: pd.DataFrame) -> pd.DataFrame:
        a = np.full((int(b["row"].max()) + 1, int(b["col"].max()) + 1), np.nan)
        a[b["row"], b["col"]] = b["value"].astype(float)
        return pd.DataFrame({"path": b["path"].iloc[:1], "content": [tiff_bytes(a, scale=(size, size), corner=(0.0, len(a) * size), nodata="nan")]})

    return cells.select("path", "row", "col", "value").groupBy("path").applyInPandas(run, "path string, content binary")


def read_complex(files: DataFrame, width: int, chunk: int = 1024) -> DataFrame:
    """path, row, col, re, im of headerless rasters of little-endian 16-bit pairs, so many rows at a time."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                a = np.frombuffer(content, "<i2", len(content) // (4 * width) * 2 * width).reshape(-1, width, 2)
                for r in range(0, len(a), chunk):
                    part = a[r : r + chunk]
                    rows, cols = np.indices(part.shape[:2])
                    yield pd.DataFrame({"path": path, "row": rows.ravel() + r, "col": cols.ravel(), "re": part[:, :, 0].ravel(), "im": part[:, :, 1].ravel()})

    return files.select("path", "content").mapInPandas(run, "path string, row long, col long, re short, im short")


# --- sheets

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_sheets(files: DataFrame) -> DataFrame:
    """path, sheet (number), row, cells (column letters to text) of .xlsx workbooks; rows without a value are left out."""
    def rows_of(content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            texts = []
            if "xl/sharedStrings.xml" in names:
                texts = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
            for name in names:
                if not (name.startswith("xl/worksheets/sheet") and name.endswith(".xml")):
                    continue
                for row in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}row"):
                    cells = {}
                    for c in row.iter(f"{_SHEET}c"):
                        v = c.find(f"{_SHEET}v")
                        text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if c.get("t") == "inlineStr" else None if v is None else texts[int(v.text)] if c.get("t") == "s" else v.text
                        if text:
                            cells[c.get("r").rstrip("0123456789")] = text
                    if cells:
                        yield int(name[19:-4]), int(row.get("r")), cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                yield pd.DataFrame([(path, *r) for r in rows_of(content)], columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet int, row int, cells map<string,string>")


def sheet_bytes(rows: list[list]) -> bytes:
    """A workbook of one sheet of inline texts (up to 26 columns)."""
    lines = []
    for n, row in enumerate(rows, 1):
        e = ElementTree.Element("row", r=str(n))
        for k, v in enumerate(row):
            c = ElementTree.SubElement(e, "c", r=f"{chr(65 + k)}{n}", t="inlineStr")
            ElementTree.SubElement(ElementTree.SubElement(c, "is"), "t").text = str(v)
        lines.append(ElementTree.tostring(e, encoding="unicode"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_SHEET[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def catalogue_search(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str, cloud: float, limit: int) -> DataFrame:
    """Landed catalogue items (json): id, datetime, cloud of those that meet the box, the days and the cloud limit, clearest first."""
    kind = "id string, bbox array<double>, properties struct<datetime: timestamp, cloud: double>"
    d = items.select(F.from_json("json", kind).alias("i")).select("i.id", "i.bbox", "i.properties.*")
    meets = (F.col("bbox")[0] <= box[2]) & (F.col("bbox")[2] >= box[0]) & (F.col("bbox")[1] <= box[3]) & (F.col("bbox")[3] >= box[1])
    d = d.where(meets & F.col("datetime").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & (F.col("cloud") < cloud))
    return d.orderBy("cloud", "id").limit(limit).select("id", "datetime", "cloud")
