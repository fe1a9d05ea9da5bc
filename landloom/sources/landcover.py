"""Land-cover JSON reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom import schema as S
from landloom.functions.rasters import landcover_valid


def tile_of_path(path: Column) -> tuple[Column, Column]:
    """Tile position from a ``tile_<col>_<row>`` folder name."""
    pattern = r"tile_(-?\d+)_(-?\d+)"
    return (
        F.regexp_extract(path, pattern, 1).cast("int"),
        F.regexp_extract(path, pattern, 2).cast("int"),
    )


def parse_landcover(docs: DataFrame, text_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(grids, pixels)`` from documents keyed by ``tile_col, tile_row``.

    Row-major classes become ``x, y, code``. The array may be called
    ``classes`` or ``data``. ``valid`` is false where its length is not
    width * height; such rasters give no pixels.
    """
    keys = ["tile_col", "tile_row"]
    doc = docs.select(*keys, F.from_json(text_col, S.LANDCOVER_JSON).alias("d"))
    doc = doc.select(*keys, "d.width", "d.height", "d.cell_size_m", F.coalesce("d.classes", "d.data").alias("classes"), "d.bounds_geo")
    n = F.coalesce(F.size("classes"), F.lit(-1))
    doc = doc.where("classes IS NOT NULL").withColumn("valid", landcover_valid(F.col("width"), F.col("height"), n))
    grids = doc.select(*keys, "width", "height", "cell_size_m", "valid", *[F.col(f"bounds_geo.{c}").alias(c) for c in S.RECT_FIELDS])
    cells = doc.where("valid").select(*keys, "width", F.posexplode("classes").alias("_i", "code"))
    pixels = cells.select(
        *keys,
        (F.col("_i") % F.col("width")).cast("int").alias("x"),
        F.floor(F.col("_i") / F.col("width")).cast("int").alias("y"),
        F.col("code").cast("int").alias("code"),
    )
    return grids, pixels


def read_landcover_json(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``(grids, pixels)`` of per-tile land-cover files; the folder names the tile."""
    path = F.col("_metadata.file_path")
    col, row = tile_of_path(path)
    docs = spark.read.text(paths, wholetext=True).select(col.alias("tile_col"), row.alias("tile_row"), "value")
    return parse_landcover(docs)


def with_tile_bounds(grids: DataFrame, tiles: DataFrame) -> DataFrame:
    """Give rasters the bounds of their manifest tile."""
    keys = ["tile_col", "tile_row"]
    return grids.select(*keys, "width", "height").join(tiles.select(*keys, *S.RECT_FIELDS), keys)
