"""Reading and writing polygon tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.geometry import RINGS, bbox, wkb_rings
from terrane.operators.attributes import nan_to_null
from terrane.operators.contiguity import snap_edges
from terrane.operators.present import numbered


def decode_wkb(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """`geometry` (WKB) replaced by `rings`; a null geometry has null rings."""
    others = [c for c in df.columns if c != geometry]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others)

    def run(batches):
        kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        for batch in batches:
            rings = pa.array([wkb_rings(g) for g in batch.column(geometry).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], rings], [*others, "rings"])

    return df.mapInArrow(run, f"{schema}{', ' if schema else ''}rings {RINGS}")


def read_polygons(spark: SparkSession, path: str, geometry: str = "geometry", node: str | None = None) -> DataFrame:
    """A parquet (or GeoParquet) table with WKB polygons: NaN made null, rings decoded; `node` names the id column."""
    df = decode_wkb(nan_to_null(spark.read.parquet(path)), geometry)
    return df if node in (None, "node_id") else df.withColumn("node_id", F.col(node))


def read_tiles(spark: SparkSession, path: str, geometry: str = "geometry", order: Column | str | None = None) -> DataFrame:
    """Tile files as one table with `tile` (file) and a global `node_id` from 1, by file and then `order`."""
    df = spark.read.parquet(path).withColumn("tile", F.col("_metadata.file_path"))
    df = df.withColumn("__o", F.monotonically_increasing_id() if order is None else (F.col(order) if isinstance(order, str) else order))
    return decode_wkb(numbered(df, ["tile", "__o"]).drop("__o"), geometry)


def tile_summary(tiles: DataFrame) -> DataFrame:
    """`(tile, n, x0, y0, x1, y1)` of `read_tiles`."""
    b = tiles.withColumn("b", bbox(F.col("rings")))
    return b.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def tile_edges(tiles: DataFrame, contiguity: str = "queen") -> tuple[DataFrame, DataFrame]:
    """(edges inside tiles, edges between tiles): one global join replaces the stitching of rims."""
    edges = snap_edges(tiles, contiguity)
    at = lambda c: tiles.select(F.col("node_id").alias(c), F.col("tile").alias(f"{c}_tile"))
    both = edges.join(at("src"), "src").join(at("dst"), "dst")
    return both.where("src_tile = dst_tile").select("src", "dst"), both.where("src_tile <> dst_tile").select("src", "dst")


def rim(tiles: DataFrame, eps: float = 1e-9) -> DataFrame:
    """`(tile, node_id)`: polygons whose box reaches their tile's box border."""
    own = tiles.select("tile", "node_id", bbox(F.col("rings")).alias("b")).join(tile_summary(tiles), "tile")
    touch = (F.col("b.x0") <= F.col("x0") + eps) | (F.col("b.y0") <= F.col("y0") + eps) | (F.col("b.x1") >= F.col("x1") - eps) | (F.col("b.y1") >= F.col("y1") - eps)
    return own.where(touch).select("tile", "node_id")


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)
