"""Writers of tiled features, manifests and per-tile rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import projection as P
from landloom.functions import rasters as R
from landloom.operators.tiling import Grid
from landloom.sources.geojson import coordinates_text, feature_text

TILE = ["tile_col", "tile_row"]
FOLDERS = 1_000  # tiles with a folder each; a file system takes longer over a folder than Spark over its rows


def packed(tiles: DataFrame) -> bool:
    """Whether there are too many tiles for a folder each; then a folder holds a column of tiles."""
    return tiles.select("tile_col").limit(FOLDERS + 1).count() > FOLDERS


def write_by_column(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Rows of any number of tiles as one table with a folder per tile column.

    Both tile columns can be read from it, as from a table with a folder per
    tile; rows are sorted, so statistics of a file's parts rule tiles out.
    """
    rows.repartitionByRange(*TILE).sortWithinPartitions(*TILE).write.mode(mode).partitionBy("tile_col").parquet(path)


def write_tiled_features(assigned: DataFrame, path: str, mode: str = "error", salt: int = 1) -> None:
    """Features partitioned by tile.

    Rows are gathered by tile first so each tile is written by few tasks;
    ``salt`` spreads every tile over that many, for very full tiles.
    """
    spread = F.pmod(F.xxhash64("feature_id"), F.lit(salt))
    assigned.repartition(*TILE, spread).write.mode(mode).partitionBy(*TILE).parquet(path)


def tile_feature_lines(assigned: DataFrame) -> DataFrame:
    """``tile_id, value``: one GeoJSON feature per row, ids and flags included."""
    extra = F.create_map(
        F.lit("feature_id"), F.col("feature_id").cast("string"), F.lit("clipped"), F.col("clipped").cast("string")
    )
    props = F.map_concat(F.map_filter("props", lambda k, _: ~k.isin("feature_id", "clipped")), extra)
    coords = coordinates_text(F.col("geom_type"), F.col("rings"), F.col("ring_is_outer"))
    return assigned.select(
        P.tile_id(F.col("tile_col"), F.col("tile_row")).alias("tile_id"),
        feature_text(F.col("geom_type"), coords, props).alias("value"),
    )


def write_tile_lines(assigned: DataFrame, path: str, mode: str = "error") -> None:
    """GeoJSON export: one folder per tile of newline-delimited features."""
    lines = tile_feature_lines(assigned)
    lines.repartition("tile_id").write.mode(mode).partitionBy("tile_id").text(path)


def manifest_document(tiles: DataFrame, grid: Grid) -> DataFrame:
    """The manifest as one JSON row (``value``); no row for an empty tile list.

    A manifest lists tiles, not features, and is one document by definition;
    jobs that scale read the tile table instead.
    """
    def rect(prefix: str = "", agg: bool = False):
        fn = {"min_lon": F.min, "min_lat": F.min, "max_lon": F.max, "max_lat": F.max}
        return F.struct(*[(fn[f](f) if agg else F.col(f)).alias(f) for f in fn])

    entry = F.struct(
        F.col("tile_col").alias("x"),
        F.col("tile_row").alias("y"),
        "geojson",
        "dem",
        "landcover",
        rect().alias("bounds_geo"),
        F.col("feature_count").alias("polygon_count"),
    )
    zone, north = F.lit(grid.zone), F.lit(grid.north)
    agg = tiles.agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("tile_col") - F.min("tile_col") + 1).alias("num_cols"),
        (F.max("tile_row") - F.min("tile_row") + 1).alias("num_rows"),
        rect(agg=True).alias("total_bounds"),
        F.array_sort(F.collect_list(entry)).alias("tiles"),
    ).where("n > 0")
    return agg.select(
        F.to_json(
            F.struct(
                P.projection_name(zone, north).alias("projection"),
                P.epsg_code(zone, north).alias("epsg"),
                F.lit(float(grid.origin_lon)).alias("origin_lon"),
                F.lit(float(grid.origin_lat)).alias("origin_lat"),
                F.lit(float(grid.tile_size_m)).alias("tile_size_m"),
                "num_cols",
                "num_rows",
                "total_bounds",
                "tiles",
            )
        ).alias("value")
    )


def write_manifest(tiles: DataFrame, grid: Grid, path: str, mode: str = "overwrite") -> bool:
    """Write the manifest; an empty tile list writes nothing and returns False."""
    doc = manifest_document(tiles, grid)
    if doc.isEmpty():
        return False
    doc.coalesce(1).write.mode(mode).text(path)
    return True


def landcover_documents(crops: DataFrame, tiles: DataFrame, pixel_degrees: float) -> DataFrame:
    """Per-tile land-cover JSON: ``tile_col, tile_row, value``.

    One tile's raster is bounded by the tile size, so its array fits a row.
    """
    arrays = crops.groupBy(*TILE, "width", "height").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "code"))), lambda p: p["code"]).alias("classes")
    )
    size = R.landcover_cell_size_m(F.lit(float(pixel_degrees)), F.col("min_lat"), F.col("max_lat"))
    joined = arrays.join(tiles.select(*TILE, "min_lat", "max_lat"), TILE).withColumn("cell_size_m", size)
    return joined.select(*TILE, F.to_json(F.struct("width", "height", "cell_size_m", "classes")).alias("value"))


def landcover_folder():
    """Relative folder of a tile's land cover."""
    return F.concat(F.lit("landcover/tile_id="), P.tile_id(F.col("tile_col"), F.col("tile_row")))


def write_landcover(documents: DataFrame, path: str, mode: str = "error") -> None:
    named = documents.select(P.tile_id(F.col("tile_col"), F.col("tile_row")).alias("tile_id"), "value")
    named.repartition("tile_id").write.mode(mode).partitionBy("tile_id").text(path)


def write_dem_tiles(resampled: DataFrame, path: str, mode: str = "error") -> None:
    """Per-tile elevation rasters in metres as FLOAT pixels."""
    rows = resampled.withColumn("elev", F.col("elev").cast("float"))
    rows.repartition(*TILE).sortWithinPartitions(*TILE, "y", "x").write.mode(mode).partitionBy(*TILE).parquet(path)
