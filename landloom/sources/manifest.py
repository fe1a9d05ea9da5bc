"""Tile manifest reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom import schema as S
from landloom.functions import projection as P


def parse_manifest(docs: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(manifest, tiles)`` from manifest documents.

    The manifest has one row per document with the grid and its projection;
    ``tiles`` one row per listed tile in list order (``tile_ord``). Grid
    positions may be spelled ``x, y`` or ``col, row``.
    """
    doc = docs.select(F.from_json(text_col, S.MANIFEST).alias("m")).where("m.tiles IS NOT NULL")
    proj = P.parse_projection(F.col("m.projection"))
    manifest = doc.select(
        "m.projection",
        proj["zone"].alias("zone"),
        proj["north"].alias("north"),
        "m.origin_lon",
        "m.origin_lat",
        "m.tile_size_m",
        "m.num_cols",
        "m.num_rows",
        "m.total_bounds",
        F.size("m.tiles").alias("num_tiles"),
    )
    tiles = doc.select(F.posexplode("m.tiles").alias("tile_ord", "t")).select(
        "tile_ord",
        F.coalesce("t.x", "t.col").alias("tile_col"),
        F.coalesce("t.y", "t.row").alias("tile_row"),
        *[F.coalesce(F.col(f"t.{c}"), F.lit("")).alias(c) for c in ("geojson", "dem", "landcover")],
        *[F.col(f"t.bounds_geo.{c}").alias(c) for c in S.RECT_FIELDS],
        F.coalesce(F.col("t.polygon_count").cast("long"), F.lit(0)).alias("feature_count"),
    )
    return manifest, tiles


def read_tile_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(manifest, tiles)`` of a manifest file."""
    return parse_manifest(spark.read.text(path, wholetext=True))
