"""A data source that reads windows of GeoTIFF files: of each file, only the blocks that a window touches."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .geotiff import Page

PIXELS = "path string, row int, col int, value double, x double, y double, x_min double, y_max double, size_x double, size_y double"
#: A task takes about so many bytes of files, or so many of one.
TASK_BYTES = 64_000_000
#: Bytes of a file's head that are read at once.
HEAD = 65_536


class _Slices:
    """Slices of a file, each read when it is asked for; the head is kept."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.head = file.read_at(min(HEAD, size), 0)

    def __getitem__(self, s: slice) -> bytes:
        start, stop = s.start or 0, min(s.stop, self.size)
        return self.head[start:stop] if stop <= len(self.head) else self.file.read_at(max(0, stop - start), start)


class _Part(InputPartition):
    """Files, of which part ``k`` of ``n`` parts of their blocks is read."""

    def __init__(self, files: list[tuple[str, int]], k: int, n: int):
        self.files, self.k, self.n = files, k, n


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.band = options["path"], options.get("pattern", "*.tif"), int(options.get("band", "0"))
        self.bounds = tuple(map(float, options["bounds"].split(","))) if "bounds" in options else None
        self.task_bytes = int(options.get("taskbytes", str(TASK_BYTES)))

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "", 1))

    def partitions(self) -> list[InputPartition]:
        """Files are listed, not opened. Small ones share a task; the blocks of a large one are dealt to several."""
        from pyarrow.fs import FileSelector

        store, root = self._store()
        found = sorted((f.path, f.size) for f in store.get_file_info(FileSelector(root, recursive=True)) if f.is_file and fnmatch.fnmatch(f.base_name, self.pattern))
        out, files, size = [], [], 0
        for path, n in found:
            parts = -(-n // self.task_bytes)
            if parts > 1:
                out += [_Part([(path, n)], k, parts) for k in range(parts)]
                continue
            if files and size + n > self.task_bytes:
                out.append(_Part(files, 0, 1))
                files, size = [], 0
            files, size = [*files, (path, n)], size + n
        return [*out, _Part(files, 0, 1)]

    def read(self, partition: _Part) -> Iterator:
        import pyarrow as pa

        store, _ = self._store()
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                page = Page(_Slices(f, size), self.band)
                wanted = page.blocks_in(self.bounds)
                lo, hi = (len(wanted) * i // partition.n for i in (partition.k, partition.k + 1))
                for k in wanted[lo:hi]:
                    r, c, values = page.block(k)
                    row, col = (a.ravel() for a in np.mgrid[r : r + values.shape[0], c : c + values.shape[1]])
                    x, y = page.place["x_min"] + col * page.place["size_x"], page.place["y_max"] - row * page.place["size_y"]
                    keep = np.ones(len(x), bool)
                    if self.bounds is not None:
                        b, (sx, sy) = self.bounds, (page.place["size_x"], page.place["size_y"])
                        keep = (x < b[2]) & (x + sx > b[0]) & (y > b[1]) & (y - sy < b[3])
                    flat = values.ravel()[keep]
                    columns = [pa.array([path] * int(keep.sum()), pa.string()), pa.array(row[keep], pa.int32()), pa.array(col[keep], pa.int32()), pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(x[keep]), pa.array(y[keep])]
                    place = ("x_min", "y_max", "size_x", "size_y")
                    columns += [pa.array(np.full(len(flat), page.place[c], float)) for c in place]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "row", "col", "value", "x", "y", *place])


class PushedReader(GeoTiffReader):
    """The reader of sessions that push filters down; others refuse one that takes them."""

    def pushFilters(self, filters) -> Iterator:
        """Comparisons of x and y narrow the window; Spark tests the pixels all the same."""
        b = list(self.bounds or (-np.inf, -np.inf, np.inf, np.inf))
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("x",):
                b[0] = max(b[0], float(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("y",):
                b[3] = min(b[3], float(f.value))
            # x and y are a pixel's upper left corner, so these ends keep the pixel that begins there
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("x",):
                b[2] = min(b[2], float(np.nextafter(float(f.value), np.inf)))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("y",):
                b[1] = max(b[1], float(np.nextafter(float(f.value), -np.inf)))
            yield f
        self.bounds = tuple(b) if any(np.isfinite(b)) else None


class GeoTiffSource(DataSource):
    """Pixels of GeoTIFF files below a folder: options ``path``, ``pattern``, ``band``, ``bounds`` ("x0,y0,x1,y1"), and
    ``pushdown``, whether filters are taken too."""

    @classmethod
    def name(cls) -> str:
        return "geotiff_window"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown") == "true" else GeoTiffReader)(options)


def read_window(spark: SparkSession, folder: str, bounds: tuple[float, float, float, float] | None = None, pattern: str = "*.tif", band: int = 0) -> DataFrame:
    """(path, row, col, value, x, y, x_min, y_max, size_x, size_y) of the pixels below a folder that share an area with the bounds (x0, y0, x1, y1).

    Missing data are null. Blocks that the window doesn't touch aren't read, and neither is a file beyond its header
    that lies outside; a file that can't be read raises. An empty folder gives no rows. Where the session pushes filters
    to Python sources (``spark.sql.python.filterPushdown.enabled``), comparisons of x and y narrow the window too.
    """
    spark.dataSource.register(GeoTiffSource)
    options = {"pattern": pattern, "band": str(band), "pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | ({"bounds": ",".join(map(repr, map(float, bounds)))} if bounds is not None else {})
    return spark.read.format("geotiff_window").options(**options).load(folder)
