"""Sampling of elevation tiles at points and on grids.

``tiles``: ``dem_id, tile_ord, min_lon, min_lat, max_lon, max_lat, width,
height``; ``pixels``: ``dem_id, px, py, elev`` with row 0 in the north.
Missing elevation is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import rasters as R

_TILE = ["dem_id", "tile_ord", "min_lon", "min_lat", "max_lon", "max_lat", "width", "height"]


def _level(extent: Column) -> Column:
    """Power of two whose cell is at least as large as the extent."""
    return F.ceil(F.log2(F.greatest(extent, F.lit(1e-9)))).cast("int")


def locate_tile(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Attach to each point (``lon, lat``) the first tile that contains it.

    Tiles are hashed to cells of about their own size, so one covers at most
    four cells, and points probe one cell for each tile size in use. Points
    in no tile keep NULL tile columns.
    """
    first = tiles.groupBy("min_lon", "min_lat", "max_lon", "max_lat").agg(
        F.min_by(F.struct("dem_id", "tile_ord", "width", "height"), "tile_ord").alias("_t")
    )
    first = first.select("min_lon", "min_lat", "max_lon", "max_lat", "_t.*")
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    first = first.withColumn("level", _level(extent))
    levels = [r[0] for r in first.select("level").distinct().collect()]  # a few tile sizes
    w = F.pow(F.lit(2.0), F.col("level"))

    def cell(v: Column) -> Column:
        return F.floor(v / w).cast("long")

    hashed = first.withColumn("cx", F.explode(F.sequence(cell(F.col("min_lon")), cell(F.col("max_lon"))))).withColumn(
        "cy", F.explode(F.sequence(cell(F.col("min_lat")), cell(F.col("max_lat"))))
    )
    spots = points.select("lon", "lat").distinct()
    probes = spots.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    probes = probes.withColumns({"cx": cell(F.col("lon")), "cy": cell(F.col("lat"))})
    within = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(
        F.col("min_lat"), F.col("max_lat")
    )
    best = (
        probes.join(hashed, ["level", "cx", "cy"])
        .where(within)
        .groupBy("lon", "lat")
        .agg(F.min_by(F.struct(*_TILE), "tile_ord").alias("_t"))
        .select("lon", "lat", "_t.*")
    )
    return points.join(best, ["lon", "lat"], "left")


def _pixel_of(points: DataFrame) -> DataFrame:
    """Add the pixel ``px, py`` under each located point, clamped to its tile."""
    nx = (F.col("lon") - F.col("min_lon")) / (F.col("max_lon") - F.col("min_lon"))
    ny = 1.0 - (F.col("lat") - F.col("min_lat")) / (F.col("max_lat") - F.col("min_lat"))

    def clamp(v: Column, n: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(v * F.col(n)).cast("int"), F.col(n) - 1))

    return points.withColumns({"px": clamp(nx, "width"), "py": clamp(ny, "height")})


def _read_pixels(points: DataFrame, pixels: DataFrame) -> DataFrame:
    values = pixels.select("dem_id", "px", "py", F.col("elev").cast("double").alias("elev"))
    return points.join(values, ["dem_id", "px", "py"], "left")


def sample_nearest(points: DataFrame, tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add ``elev`` from the first containing tile; NULL outside all tiles."""
    located = _pixel_of(locate_tile(points, tiles))
    return _read_pixels(located, pixels).select(*points.columns, "elev")


def sample_first_tile(points: DataFrame, tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add ``elev`` from the first tile only; points outside it are clamped."""
    first = tiles.orderBy("tile_ord").limit(1).select(F.lit(1).alias("_k"), *_TILE)
    located = _pixel_of(points.withColumn("_k", F.lit(1)).join(F.broadcast(first), "_k"))  # exactly one row
    return _read_pixels(located, pixels).select(*points.columns, "elev")


def sample_bilinear(points: DataFrame, tiles: DataFrame, pixels: DataFrame) -> DataFrame:
    """Add bilinear ``elev``; any missing corner falls back to nearest.

    The fraction is not clamped, so values extrapolate at the tile edge.
    """
    located = _pixel_of(locate_tile(points.select("lon", "lat").distinct(), tiles))
    fx = (F.col("lon") - F.col("min_lon")) / (F.col("max_lon") - F.col("min_lon")) * F.col("width") - 0.5
    fy = (1.0 - (F.col("lat") - F.col("min_lat")) / (F.col("max_lat") - F.col("min_lat"))) * F.col("height") - 0.5

    def corner(v: Column, n: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), F.col(n) - 2))

    located = located.withColumns({"x0": corner(fx, "width"), "y0": corner(fy, "height")})
    located = located.withColumns({"sx": fx - F.col("x0"), "sy": fy - F.col("y0"), "npx": F.col("px"), "npy": F.col("py")})
    corners = F.array(
        *[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, i, j in
          (("v00", 0, 0), ("v10", 1, 0), ("v01", 0, 1), ("v11", 1, 1))],
        F.struct(F.lit("near").alias("k"), F.lit(0).alias("i"), F.lit(0).alias("j")),
    )
    wanted = located.withColumn("_c", F.explode(corners)).withColumns(
        {
            "px": F.when(F.col("_c.k") == "near", F.col("npx")).otherwise(F.col("x0") + F.col("_c.i")),
            "py": F.when(F.col("_c.k") == "near", F.col("npy")).otherwise(F.col("y0") + F.col("_c.j")),
        }
    )
    got = _read_pixels(wanted, pixels)

    def value(k: str) -> Column:
        return F.max(F.when(F.col("_c.k") == k, F.col("elev"))).alias(k)

    flat = got.groupBy("lon", "lat", "sx", "sy").agg(*[value(k) for k in ("v00", "v10", "v01", "v11", "near")])
    south = F.col("v00") + (F.col("v10") - F.col("v00")) * F.col("sx")
    north = F.col("v01") + (F.col("v11") - F.col("v01")) * F.col("sx")
    elev = F.coalesce(south + (north - south) * F.col("sy"), F.col("near"))
    return points.join(flat.select("lon", "lat", elev.alias("elev")), ["lon", "lat"], "left").select(
        *points.columns, "elev"
    )


def grid_shape(bounds, resolution_m: float) -> tuple[int, int]:
    """Columns and rows of an analysis grid over ``(min_lon, min_lat, max_lon, max_lat)``."""
    lo_x, lo_y, hi_x, hi_y = bounds
    per_lon = R.GRID_M_PER_DEG_LON * math.cos(math.radians((lo_y + hi_y) / 2.0))
    width = max(1, math.ceil((hi_x - lo_x) * per_lon / resolution_m))
    height = max(1, math.ceil((hi_y - lo_y) * R.GRID_M_PER_DEG_LAT / resolution_m))
    return width, height


def grid_points(spark: SparkSession, bounds, width: int, height: int, grid_id: str = "grid") -> DataFrame:
    """Cell centres ``grid_id, x, y, lon, lat`` of a grid, row 0 in the south."""
    lo_x, lo_y, hi_x, hi_y = map(float, bounds)
    step_x, step_y = (hi_x - lo_x) / width, (hi_y - lo_y) / height
    cells = spark.range(width * height)
    x, y = (F.col("id") % width).cast("int"), F.floor(F.col("id") / width).cast("int")
    return cells.select(F.lit(grid_id).alias("grid_id"), x.alias("x"), y.alias("y")).withColumns(
        {"lon": lo_x + (F.col("x") + 0.5) * step_x, "lat": lo_y + (F.col("y") + 0.5) * step_y}
    )


def elevation_grid(
    spark: SparkSession, tiles: DataFrame, pixels: DataFrame, bounds, resolution_m: float = 30.0, grid_id: str = "grid"
) -> DataFrame:
    """Elevation ``grid_id, x, y, lon, lat, elev`` resampled over the bounds."""
    width, height = grid_shape(bounds, resolution_m)
    return sample_nearest(grid_points(spark, bounds, width, height, grid_id), tiles, pixels)


def resample_tiles(target_tiles: DataFrame, tiles: DataFrame, pixels: DataFrame, size: int = 256) -> DataFrame:
    """``size`` x ``size`` elevation raster per target tile, row 0 in the north.

    ``target_tiles`` has ``tile_col, tile_row`` and geographic bounds.
    """
    lo_x, lo_y, hi_x, hi_y = (F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat"))
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    wanted = (
        target_tiles.select("tile_col", "tile_row", "min_lon", "min_lat", "max_lon", "max_lat")
        .withColumn("x", F.explode(axis))
        .withColumn("y", F.explode(axis))
    )
    points = wanted.select(
        "tile_col",
        "tile_row",
        "x",
        "y",
        (lo_x + (F.col("x") + 0.5) * ((hi_x - lo_x) / size)).alias("lon"),
        (hi_y - (F.col("y") + 0.5) * ((hi_y - lo_y) / size)).alias("lat"),
    )
    return sample_nearest(points, tiles, pixels).select("tile_col", "tile_row", "x", "y", "elev")
