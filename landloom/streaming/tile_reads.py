"""Tile reads around a world position, by partition pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.operators import filters as Fl
from landloom.sinks.store import read_store


def read_tiles_in_box(
    spark: SparkSession, path: str, min_x: float, min_y: float, max_x: float, max_y: float, tile_size_m: float
) -> DataFrame:
    """Stored polygons of the tiles under a world box (whole tiles)."""
    return Fl.tiles_in_world_box(read_store(spark, path), min_x, min_y, max_x, max_y, tile_size_m)


def read_tile(spark: SparkSession, path: str, col: int, row: int) -> DataFrame:
    """Stored polygons of one tile (one partition directory)."""
    return read_store(spark, path).where(f"tile_col = {int(col)} AND tile_row = {int(row)}")


def read_around(
    spark: SparkSession, path: str, x: float, y: float, tile_size_m: float = 1024.0, radius: int = 3
) -> DataFrame:
    """Stored polygons centred within the load radius of a position.

    The tile range prunes partitions, the index cells prune row groups, and the
    exact box decides. Tiles one step outside are included in the first, since
    tile borders and the local frame differ slightly.
    """
    box = Fl.load_radius_box(x, y, tile_size_m, radius)
    edge = tile_size_m * 100.0
    tiles = Fl.tiles_in_world_box(
        read_store(spark, path), box[0] - edge, box[1] - edge, box[2] + edge, box[3] + edge, tile_size_m
    )
    return Fl.center_in_world_box(tiles, *box)
