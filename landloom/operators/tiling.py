"""Assignment of features to square tiles, and per-tile roll-ups."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import projection as P


@dataclass(frozen=True)
class Grid:
    """A tile grid: size in metres and geographic origin."""

    tile_size_m: float
    origin_lon: float
    origin_lat: float

    @property
    def zone(self) -> int:
        return int(math.floor((self.origin_lon + 180.0) / 6.0)) + 1

    @property
    def north(self) -> bool:
        return self.origin_lat >= 0.0

    def with_tiles(self, df: DataFrame, points: dict[str, tuple[str, str]]) -> DataFrame:
        """Add ``<name>_col, <name>_row`` for each named pair of lon, lat expressions."""
        return P.with_tiles(df, points, self.tile_size_m, self.origin_lon, self.origin_lat)

    def bounds_of(self, col, row):
        return P.tile_bounds(col, row, self.tile_size_m, self.origin_lon, self.origin_lat)


def with_bbox(features: DataFrame) -> DataFrame:
    """Add ``min_lon, min_lat, max_lon, max_lat`` over all rings."""
    return features.withColumn("_bbox", G.feature_bbox(F.col("rings"))).select("*", "_bbox.*").drop("_bbox")


def assign_tiles(features: DataFrame, grid: Grid) -> DataFrame:
    """One row per feature and covered tile; needs the bounding box columns.

    Adds ``tile_col, tile_row, clipped``: every tile between the tiles of the
    two bounding box corners, and whether those corners differ. Pure row
    expansion: no join and no shuffle. An inverted corner pair covers nothing,
    as an empty range does.
    """
    corners = {"_lo": ("min_lon", "min_lat"), "_hi": ("max_lon", "max_lat")}
    df = grid.with_tiles(features, corners)
    differ = (F.col("_lo_col") != F.col("_hi_col")) | (F.col("_lo_row") != F.col("_hi_row"))

    def span(lo: str, hi: str):
        return F.when(F.col(lo) <= F.col(hi), F.sequence(lo, hi))

    df = df.withColumn("clipped", differ).withColumn("tile_col", F.explode(span("_lo_col", "_hi_col")))
    df = df.withColumn("tile_row", F.explode(span("_lo_row", "_hi_row")))
    return df.drop("_lo_col", "_lo_row", "_hi_col", "_hi_row")


def tile_counts(assigned: DataFrame) -> DataFrame:
    """Features per tile."""
    return assigned.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("feature_count"))


def with_tile_bounds(tiles: DataFrame, grid: Grid) -> DataFrame:
    return tiles.withColumn("_b", grid.bounds_of(F.col("tile_col"), F.col("tile_row"))).select("*", "_b.*").drop("_b")


def tile_table(assigned: DataFrame, grid: Grid) -> DataFrame:
    """The tile list of a tiling run: counts, bounds and relative paths.

    ``geojson`` names the tile's folder in the stored feature table.
    """
    tiles = with_tile_bounds(tile_counts(assigned), grid)
    return tiles.withColumns(
        {
            "geojson": stored_folder("features"),
            "dem": F.lit(""),
            "landcover": F.lit(""),
        }
    )


def stored_folder(kind: str):
    """Relative folder of a tile in a table partitioned by tile."""
    return F.concat(F.lit(f"{kind}/tile_col="), F.col("tile_col").cast("string"), F.lit("/tile_row="), F.col("tile_row").cast("string"))


def manifest_rollup(tiles: DataFrame) -> DataFrame:
    """Grid extent, total bounds, and feature total of a tile list (one row)."""
    agg = tiles.agg(
        F.count(F.lit(1)).alias("num_tiles"),
        F.min("tile_col").alias("min_col"),
        F.max("tile_col").alias("max_col"),
        F.min("tile_row").alias("min_row"),
        F.max("tile_row").alias("max_row"),
        F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lon").alias("max_lon"),
        F.max("max_lat").alias("max_lat"),
        F.sum("feature_count").alias("total_features"),
    ).where("num_tiles > 0")
    return agg.withColumns(
        {
            "num_cols": F.col("max_col") - F.col("min_col") + 1,
            "num_rows": F.col("max_row") - F.col("min_row") + 1,
        }
    )


def first_copies(rows: DataFrame, id_col: str = "feature_id", order_cols: tuple[str, ...] = ("tile_ord",)) -> DataFrame:
    """One row per id: the copy in the first tile; rows without id all stay.

    ``min_by`` keeps one candidate per id on the map side, so an id with very
    many copies shuffles one row per task.
    """
    cols = rows.columns
    order = F.struct(*order_cols)
    with_id = (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min_by(F.struct(*cols), order).alias("_r"))
        .select("_r.*")
        .select(*cols)
    )
    return with_id.unionByName(rows.where(F.col(id_col).isNull()))


def duplicate_tiles(tiles: DataFrame) -> DataFrame:
    """Tile coordinates listed more than once."""
    return (
        tiles.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    )


def busiest_tile(tiles: DataFrame, order_col: str = "tile_ord") -> DataFrame:
    """The tile with most features; the first in order wins ties."""
    return tiles.orderBy(F.desc("feature_count"), F.asc(order_col)).limit(1)


def sorted_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("tile_col", "tile_row")


def tiles_for_bounds(queries: DataFrame, tiles: DataFrame, grid: Grid) -> DataFrame:
    """Join many query rectangles ``q_min_lon ..`` to the tiles they touch.

    Both sides are hashed to cells of one tile's extent, which turns the
    interval test into an equi-join; the four comparisons then decide (shared
    edges count), and a pair is kept in the lowest cell both cover.
    """
    dlat = grid.tile_size_m / P.meters_per_degree_lat()
    dlon = dlat / math.cos(math.radians(grid.origin_lat))

    def cells(df: DataFrame, prefix: str) -> DataFrame:
        def index(name: str, origin: float, step: float):
            return F.floor((F.col(f"{prefix}{name}") - origin) / step).cast("long")

        lo_x, lo_y = index("min_lon", grid.origin_lon, dlon), index("min_lat", grid.origin_lat, dlat)
        hi_x, hi_y = index("max_lon", grid.origin_lon, dlon), index("max_lat", grid.origin_lat, dlat)
        df = df.withColumns({f"_{prefix}x": lo_x, f"_{prefix}y": lo_y, "_hx": hi_x, "_hy": hi_y})
        df = df.withColumn("_cx", F.explode(F.sequence(f"_{prefix}x", "_hx")))
        return df.withColumn("_cy", F.explode(F.sequence(f"_{prefix}y", "_hy"))).drop("_hx", "_hy")

    touching = (
        (F.col("max_lon") >= F.col("q_min_lon"))
        & (F.col("min_lon") <= F.col("q_max_lon"))
        & (F.col("max_lat") >= F.col("q_min_lat"))
        & (F.col("min_lat") <= F.col("q_max_lat"))
    )
    lowest = (F.col("_cx") == F.greatest("_q_x", "_x")) & (F.col("_cy") == F.greatest("_q_y", "_y"))
    joined = cells(queries, "q_").join(cells(tiles, ""), ["_cx", "_cy"]).where(touching & lowest)
    return joined.drop("_cx", "_cy", "_q_x", "_q_y", "_x", "_y")
