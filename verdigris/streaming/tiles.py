"""Resumable tile jobs: what is left to do, a log of what was done, and a stream over a folder of new tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import geotiff, vectors
from ..tables import shared_table

LOG_COLUMNS = ("tile_name", "file_name", "layer", "path", "error", "elapsed_sec")


def pending(tiles: DataFrame, layers: list[str], done: DataFrame, tile: str = "tile_name") -> DataFrame:
    """(tile, layer) pairs that ``done`` doesn't have: a tile is retried for the layers that it lacks only."""
    every = tiles.select(tile, F.explode(F.array(*map(F.lit, layers))).alias("layer"))
    return every.join(done.select(tile, "layer"), [tile, "layer"], "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Append a batch of log rows, all as text, in one write."""
    rows.select(*[F.col(c).cast("string").alias(c) for c in LOG_COLUMNS]).write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in LOG_COLUMNS)).csv(path)


def process_new_tiles(spark: SparkSession, folder: str, pattern: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Give all files that are new since the last call to ``handle`` (paths and bytes, batch number), then stop.

    The checkpoint remembers what was read, so a job that is started again goes on where the last one ended.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def vectorise_folder(spark: SparkSession, folder: str, out: str, log: str, layers: dict[str, tuple[float, Callable[[DataFrame], DataFrame]]], pattern: str = "*.tif") -> None:
    """Make the layers (name: step and kernel) of all rasters of a folder that the log doesn't have without an error.

    Each layer's polygons go to the vector cache ``out``, and each tile gets a row in the log, with the seconds that it
    took and the text of its error. A job that is started again does what is missing or failed.
    """
    files = geotiff.listing(spark, folder, pattern).withColumn("tile_name", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    log_path = spark._jvm.org.apache.hadoop.fs.Path(log)
    known = log_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(log_path)
    done = read_log(spark, log).filter("error IS NULL").select("tile_name", "layer") if known else spark.createDataFrame([], "tile_name string, layer string")
    left = shared_table(pending(files, list(layers), done), "pending")
    for layer, (step, kernel) in layers.items():
        wanted = files.join(left.filter(F.col("layer") == layer).select("tile_name"), "tile_name", "left_semi")
        if not wanted.limit(1).count():
            continue
        tiles = geotiff.read_tiles(spark, folder, pattern).join(wanted.select("path", "file_name", "tile_name"), "path", "left_semi")
        made = shared_table(kernel(tiles), "made").withColumn("tile_name", F.regexp_replace("tile", r"\.[^.]*$", ""))
        vectors.write_layer(made.filter("error IS NULL").select("tile_name", "value", "geom"), out, layer, step)
        facts = made.groupBy("tile_name").agg(F.max("error").alias("error"), F.max("elapsed_sec").alias("elapsed_sec"))
        # a tile without any class has no polygons but is done, too
        rows = wanted.select("tile_name", "file_name").join(facts, "tile_name", "left")
        append_log(rows.select("tile_name", "file_name", F.lit(layer).alias("layer"), F.lit(out).alias("path"), F.regexp_replace("error", "[\\r\\n]+", " | ").alias("error"), F.coalesce("elapsed_sec", F.lit(0.0)).alias("elapsed_sec")), log)
