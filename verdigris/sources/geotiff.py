"""GeoTIFF tiles: a baseline decoder (strips or tiles; none, deflate, LZW or PackBits; predictors), and Spark scans.

Rows are (tile, path, georef, height, width, values): a tile is one row, as neighbourhood work needs it whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, tile string, x_min double, y_max double, size_x double, size_y double, srid int, height int, width int, values array<double>, error string"
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tags(data) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first page; ``data`` are bytes, or what reads slices of them."""
    def get(fmt: str, at: int) -> tuple:
        return struct.unpack(fmt, data[at : at + struct.calcsize(fmt)])

    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or get(order + "H", 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = get(order + "I", 4)
    (n,) = get(order + "H", at)
    tags = {}
    for i in range(n):
        tag, kind, count = get(order + "HHI", at + 2 + 12 * i)
        code = _TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(code) * count
        place = at + 10 + 12 * i if size <= 4 else get(order + "I", at + 10 + 12 * i)[0]
        tags[tag] = (data[place : place + count].rstrip(b"\0").decode("latin-1"),) if code == "s" else get(f"{order}{count}{code}", place)
    return order, tags


def _lzw(data: bytes) -> bytes:
    out, table, bits, width, have, old = bytearray(), [], 0, 9, 0, None
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        while have >= width:
            code = (bits >> (have - width)) & ((1 << width) - 1)
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, old = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            entry = table[code] if code < len(table) else old + old[:1]
            out += entry
            if old is not None:
                table.append(old + entry[:1])
            old = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


class Page:
    """The first page of a file: its size, blocks and place. The tie point is taken as the centre of its pixel, so the
    extent is moved by half a pixel. Raises ValueError when the georeferencing tags are missing."""

    def __init__(self, data, band: int = 0, nodata: float = -9999.0):
        self.data, self.band = data, band
        order, t = _tags(data)
        if 33550 not in t or 33922 not in t:
            raise ValueError("no ModelPixelScale or ModelTiepoint tag")
        self.width, self.height, samples = t[256][0], t[257][0], t.get(277, (1,))[0]
        self.size, kind = t.get(258, (1,))[0] // 8, t.get(339, (1,))[0]
        self.dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind]}{self.size}")
        separate = t.get(284, (1,))[0] == 2 and samples > 1
        if 322 in t:
            self.block_w, self.block_h, self.offsets, self.counts = t[322][0], t[323][0], t[324], t[325]
        else:
            self.block_w, self.block_h, self.offsets, self.counts = self.width, min(t.get(278, (self.height,))[0], self.height), t[273], t[279]
        self.across, self.down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        self.per = 1 if separate else samples
        self.sample, self.first = (0, band * self.across * self.down) if separate else (band, 0)
        self.unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: _lzw, 32773: _packbits}[t.get(259, (1,))[0]]
        self.predictor = t.get(317, (1,))[0]
        try:
            self.missing = float(t[42113][0]) if 42113 in t else nodata
        except ValueError:
            self.missing = nodata
        (sx, sy), tie = t[33550][:2], t[33922]
        keys = t.get(34735, ())
        srid = next((v for k, where, _, v in zip(keys[4::4], keys[5::4], keys[6::4], keys[7::4]) if k in (3072, 2048) and where == 0), 4326)
        self.place = {"x_min": tie[3] - tie[0] * sx - sx / 2, "y_max": tie[4] + tie[1] * sy + sy / 2, "size_x": sx, "size_y": sy, "srid": srid}

    def block(self, k: int) -> tuple[int, int, np.ndarray]:
        """(row, column, values) of a block, missing data as NaN; only its bytes are read."""
        at = self.offsets[self.first + k]
        raw = self.unpack(self.data[at : at + self.counts[self.first + k]])
        rows = len(raw) // (self.block_w * self.per * self.size)
        if self.predictor == 3:
            planes = np.frombuffer(raw, np.uint8).reshape(rows, self.size, self.block_w * self.per)
            flat = np.cumsum(planes.reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, self.size, -1)
            values = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">{self.dtype.kind}{self.size}").reshape(rows, self.block_w, self.per)
        else:
            values = np.frombuffer(raw[: rows * self.block_w * self.per * self.size], self.dtype).reshape(rows, self.block_w, self.per)
            if self.predictor == 2:
                values = np.cumsum(values, axis=1, dtype=values.dtype)
        r, c = k // self.across * self.block_h, k % self.across * self.block_w
        found = values[: self.height - r, : self.width - c, self.sample].astype(float)
        found[found == self.missing] = np.nan
        return r, c, found

    def blocks_in(self, bounds: tuple[float, float, float, float] | None) -> list[int]:
        """Blocks with a pixel that shares an area with the bounds (x0, y0, x1, y1)."""
        if bounds is None:
            return list(range(self.across * self.down))
        g = self.place
        cols = (bounds[0] - g["x_min"]) / g["size_x"], (bounds[2] - g["x_min"]) / g["size_x"]
        rows = (g["y_max"] - bounds[3]) / g["size_y"], (g["y_max"] - bounds[1]) / g["size_y"]
        down = [i for i in range(self.down) if i * self.block_h < rows[1] and min((i + 1) * self.block_h, self.height) > rows[0]]
        return [i * self.across + j for i in down for j in range(self.across) if j * self.block_w < cols[1] and min((j + 1) * self.block_w, self.width) > cols[0]]


def decode(data, band: int = 0, nodata: float = -9999.0) -> tuple[np.ndarray, dict]:
    """(values with missing data as NaN, georeference) of the first page."""
    page = Page(data, band, nodata)
    out = np.zeros((page.height, page.width), float)
    for k in range(page.across * page.down):
        r, c, values = page.block(k)
        out[r : r + values.shape[0], c : c + values.shape[1]] = values
    return out, page.place


def encode(values: np.ndarray, x0: float, y0: float, size: float, nodata: float = -9999.0) -> bytes:
    """A small float32 GeoTIFF (one deflated strip) with its first pixel's centre at (x0, y0)."""
    body = zlib.compress(np.where(np.isfinite(values), values, nodata).astype("<f4").tobytes())
    h, w = values.shape
    missing = f"{nodata:g}".encode() + b"\0"
    extra = [(33550, 12, struct.pack("<3d", size, size, 0)), (33922, 12, struct.pack("<6d", 0, 0, 0, x0, y0, 0)), (42113, 2, missing)]
    entries = [(256, 4, w), (257, 4, h), (258, 3, 32), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, len(body)), (339, 3, 3)]
    at, blobs = 8 + len(body), b""
    tags = [struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries]
    for tag, kind, blob in extra:
        count = len(blob) // (8 if kind == 12 else 1)
        tags.append(struct.pack("<HHII", tag, kind, count, at + len(blobs)))
        blobs += blob
    return struct.pack("<2sHI", b"II", 42, at + len(blobs)) + body + blobs + struct.pack("<H", len(tags)) + b"".join(tags) + struct.pack("<I", 0)


def _decode_rows(band: int, batches) -> Iterator:
    import pandas as pd

    for b in batches:
        rows = []
        for path, content in zip(b["path"], b["content"]):
            name = path.rsplit("/", 1)[-1]
            try:
                values, g = decode(content, band)
                flat = [None if v != v else v for v in values.ravel().tolist()]
                rows.append((path, name, g["x_min"], g["y_max"], g["size_x"], g["size_y"], g["srid"], *values.shape, flat, None))
            except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                rows.append((path, name, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def listing(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """(path, file_name) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def read_tiles(spark: SparkSession, folder: str, pattern: str = "*.tif", band: int = 0) -> DataFrame:
    """All tiles below a folder; a file that can't be read has its error instead of values."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    from functools import partial

    return files.select("path", "content").mapInPandas(partial(_decode_rows, band), SCHEMA)


def pixels(tiles: DataFrame) -> DataFrame:
    """(tile, row, col, value, x, y) of all pixels, with the map coordinates of their upper left corners."""
    out = tiles.filter("error IS NULL").select("tile", "x_min", "y_max", "size_x", "size_y", "width", F.posexplode("values").alias("pos", "value"))
    out = out.withColumns({"row": F.call_function("div", F.col("pos"), F.col("width")).cast("int"), "col": (F.col("pos") % F.col("width")).cast("int")})
    return out.select("tile", "row", "col", "value", (F.col("x_min") + F.col("col") * F.col("size_x")).alias("x"), (F.col("y_max") - F.col("row") * F.col("size_y")).alias("y"))
