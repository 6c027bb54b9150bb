"""GeoParquet: Parquet files with ``geo`` metadata and a covering box of each row, in the order of a space-filling curve.

Rows that lie near each other are in one row group, so a filter on the box, which is pushed to the scan, skips the
others. Files are written by a Python data source, as Spark's writer sets no metadata of a file; they are read by
Spark's own reader.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.coordinates import total_bounds

SIDES = ("xmin", "ymin", "xmax", "ymax")
BOX = ("x0", "y0", "x1", "y1")
ROW_GROUP, FILE_ROWS = 20_000, 1_000_000


def _spread(n: Column) -> Column:
    """The 16 bits of a number with a 0 between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def curve_key(x: Column, y: Column, bounds: dict[str, Column]) -> Column:
    """The place of a point on a Z-shaped curve through the bounds, in 32 bits; points beyond count as on the edge."""
    def step(v: Column, lo: Column, hi: Column) -> Column:
        share = (v - lo) / F.nullif(hi - lo, F.lit(0.0))
        return F.coalesce(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * 65535), F.lit(0)).cast("long")

    return _spread(step(x, bounds["x0"], bounds["x1"])).bitwiseOR(F.shiftleft(_spread(step(y, bounds["y0"], bounds["y1"])), 1))


def geo_metadata(geometry: str, srid: int | None, bounds: list[float] | None) -> dict:
    column: dict = {"encoding": "WKB", "geometry_types": [], "covering": {"bbox": {s: ["bbox", s] for s in SIDES}}}
    if bounds is not None:
        column["bbox"] = bounds
    if srid not in (None, 4326):  # without one, coordinates are longitude and latitude
        column["crs"] = {"type": "ProjectedCRS", "name": f"EPSG:{srid}", "id": {"authority": "EPSG", "code": srid}}
    return {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class GeoParquetWriter(DataSourceArrowWriter):
    """Each task writes a file beside the others, which only a commit of all brings to its place."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.geometry, self.overwrite = options["path"], options.get("geometry", "geometry"), overwrite
        self.srid = int(options["srid"]) if options.get("srid") else None
        self.row_group = int(options.get("rowgroup", str(ROW_GROUP)))
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "", 1))

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, root = self._store()
        name, writer, held, rows, bounds = f"part-{uuid.uuid4().hex}.parquet", None, [], 0, None

        def flush():
            nonlocal held, rows
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=self.row_group)
            held, rows = [], 0

        for b in iterator:
            if not b.num_rows:
                continue
            if writer is None:
                store.create_dir(f"{root}/{self.staging}", recursive=True)
                writer = pq.ParquetWriter(f"{root}/{self.staging}/{name}", b.schema, filesystem=store)
            ends = [f(pc.struct_field(b.column("bbox"), s)).as_py() for s, f in zip(SIDES, (pc.min, pc.min, pc.max, pc.max))]
            if None not in ends:
                bounds = ends if bounds is None else [f(p, q) for f, p, q in zip((min, min, max, max), bounds, ends)]
            for start in range(0, b.num_rows, self.row_group):
                piece = b.slice(start, self.row_group)
                if rows + piece.num_rows > self.row_group:
                    flush()
                held, rows = [*held, piece], rows + piece.num_rows
        if writer is None:
            return _Written([])
        flush()
        writer.add_key_value_metadata({"geo": json.dumps(geo_metadata(self.geometry, self.srid, bounds))})
        writer.close()
        return _Written([name])

    def commit(self, messages: list) -> None:
        store, root = self._store()
        store.create_dir(root, recursive=True)
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for f in store.get_file_info(FileSelector(root)):
                if f.is_file:
                    store.delete_file(f.path)
        for m in messages:
            for name in m.files if m else []:
                store.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*self._store())

    def _clear(self, store, root: str) -> None:
        from pyarrow.fs import FileType

        if store.get_file_info(f"{root}/{self.staging}").type != FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class GeoParquetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return GeoParquetWriter(dict(self.options), overwrite)


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry", srid: int | None = None, mode: str = "append", row_group: int = ROW_GROUP, file_rows: int = FILE_ROWS) -> None:
    """Write rows (a WKB column, x0 .. y1 and others) to a folder; the box goes to the covering column ``bbox``.

    ``mode`` is append or overwrite. Rows with a null box come first on the curve, and no bounds skip their group. An
    empty table writes no file.
    """
    spark = df.sparkSession
    spark.dataSource.register(GeoParquetSource)
    n = df.count()
    bounds = total_bounds(df).withColumnsRenamed({c: f"_{c}" for c in BOX})  # one row
    middle = [(F.col(a) + F.col(b)) / 2 for a, b in (("x0", "x1"), ("y0", "y1"))]
    keyed = df.crossJoin(F.broadcast(bounds)).withColumn("_key", curve_key(*middle, {c: F.col(f"_{c}") for c in BOX}))
    ordered = keyed.repartitionByRange(max(1, -(-n // file_rows)), "_key").sortWithinPartitions("_key")
    rest = [c for c in df.columns if c not in BOX]
    out = ordered.select(*rest, F.struct(*[F.col(c).cast("double").alias(s) for c, s in zip(BOX, SIDES)]).alias("bbox"))
    out.write.format("geoparquet").options(geometry=geometry, rowgroup=str(row_group), **({"srid": str(srid)} if srid else {})).mode(mode).save(path)


def read_geoparquet(spark: SparkSession, path: str, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The rows of a folder, with their box as x0 .. y1; with bounds (x0, y0, x1, y1), those whose box touches them.

    The comparisons with bounds reach the scan, which skips row groups by them."""
    found = spark.read.parquet(path)
    if bounds is not None:
        x0, y0, x1, y1 = map(float, bounds)
        found = found.filter((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
    return found.select(*[c for c in found.columns if c != "bbox"], *[F.col(f"bbox.{s}").alias(c) for s, c in zip(SIDES, BOX)])


def read_metadata(path: str) -> dict[str, dict]:
    """The ``geo`` metadata of each file of a folder, by the file's name; only footers are read."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector, FileSystem

    store, root = FileSystem.from_uri(path if "://" in path else path.replace("file:", "", 1))
    out = {}
    for f in store.get_file_info(FileSelector(root)):
        if f.is_file and f.base_name.endswith(".parquet"):
            out[f.base_name] = json.loads(pq.ParquetFile(f.path, filesystem=store).metadata.metadata[b"geo"])
    return out
