"""The land-use store: polygons by tile, clustered for box queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import projection as P
from landloom.operators.stats import catalog
from landloom.schema import LAND_USE_POLYGON, RECT

TILE = ["tile_col", "tile_row"]


def indexed(polygons: DataFrame, cell_size_cm: float = 50000.0) -> DataFrame:
    """Add index cell and world bounds to polygons."""
    cell = P.world_to_cell(F.col("center_x"), F.col("center_y"), cell_size_cm)
    return polygons.withColumns(
        {
            "cell_x": cell["cell_x"],
            "cell_y": cell["cell_y"],
            "world_bounds": G.bbox(F.col("world_vertices"), "x", "y"),
        }
    )


def write_store(polygons: DataFrame, path: str, mode: str = "error", cell_size_cm: float = 50000.0, files_per_tile: int = 1) -> None:
    """Write polygons partitioned by tile and sorted by index cell.

    Parquet statistics on ``cell_x, cell_y`` then prune box queries inside a
    tile. ``files_per_tile`` splits tiles that hold very many polygons.
    """
    cols = [f.name for f in LAND_USE_POLYGON.fields if f.name in polygons.columns]
    df = indexed(polygons.select(*cols), cell_size_cm)
    spread = F.pmod(F.xxhash64("cell_x", "cell_y", "polygon_id"), F.lit(files_per_tile))
    df.repartition(*TILE, spread).sortWithinPartitions(*TILE, "cell_x", "cell_y").write.mode(mode).partitionBy(*TILE).parquet(path)


def store_metadata(spark: SparkSession, origin_lon: float, origin_lat: float, bounds, provider: str, cell_size_cm: float = 50000.0) -> DataFrame:
    """Origin, source bounds, provider and time of a store (one row)."""
    row = [(float(origin_lon), float(origin_lat), tuple(map(float, bounds)) if bounds else None, provider, float(cell_size_cm))]
    schema = f"origin_lon double, origin_lat double, source_bounds {RECT.simpleString()}, source_provider string, cell_size_cm double"
    return spark.createDataFrame(row, schema).withColumn("generated_time", F.current_timestamp())


def write_catalog(polygons: DataFrame, path: str, tile_size_m: float, origin_lon: float, origin_lat: float, zone: int, mode: str = "overwrite") -> None:
    """Stored tiles with their counts and the grid they belong to."""
    catalog(polygons).withColumns(
        {
            "tile_size_m": F.lit(float(tile_size_m)),
            "origin_lon": F.lit(float(origin_lon)),
            "origin_lat": F.lit(float(origin_lat)),
            "utm_zone": F.lit(int(zone)),
            "generated_time": F.current_timestamp(),
        }
    ).write.mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def catalog_counts(registered: DataFrame, loaded: DataFrame) -> DataFrame:
    """Numbers of registered and of loaded tiles."""
    a = registered.agg(F.count(F.lit(1)).alias("all_tiles")).withColumn("_k", F.lit(1))
    b = loaded.select(*TILE).distinct().agg(F.count(F.lit(1)).alias("loaded_tiles")).withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k")
