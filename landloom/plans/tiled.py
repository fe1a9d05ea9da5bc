"""Jobs over a tiled data set: cutting into tiles and building the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.operators import classify as C
from landloom.operators import elevation, landcover, tiling, validate
from landloom.plans import derive as D
from landloom.schema import RECT_FIELDS, ClassifyRules
from landloom.session import checkpointed
from landloom.sinks import tiles as K
from landloom.sources import dem as dem_source
from landloom.sources import discovery, geojson, manifest

TILE = ["tile_col", "tile_row"]


def cut_into_tiles(features: DataFrame, grid: tiling.Grid) -> tuple[DataFrame, DataFrame]:
    """``(feature rows per tile, tile table)`` of features with ids."""
    assigned = tiling.assign_tiles(tiling.with_bbox(features), grid)
    return assigned, tiling.tile_table(assigned, grid)


def query_tile_features(copies: DataFrame, tiles: DataFrame, grid: tiling.Grid, only: DataFrame | None = None) -> DataFrame:
    """Features of every tile's own query, all tiles at once (of the tiles ``only``, where given).

    For each tile: the copies in tiles that touch it, the first copy per
    feature id in manifest order, kept if its vertex mean is in the tile.
    ``copies`` has ``tile_col, tile_row, feature_id, coords``; the result has
    the querying tile in ``tile_col, tile_row``.

    Only ids and centres travel to the neighbouring tiles; geometry is joined
    back once, for the copies that were kept.
    """
    c = G.vertex_mean(F.col("coords"), "lon", "lat")
    light = copies.select("feature_id", *TILE, c["lon"].alias("c_lon"), c["lat"].alias("c_lat"))
    own = tiles.select(*TILE, "tile_ord", *RECT_FIELDS)
    asked = own if only is None else own.join(only.select(*TILE), TILE, "left_semi")
    q = asked.select(F.col("tile_col").alias("q_col"), F.col("tile_row").alias("q_row"), *[F.col(f).alias(f"q_{f}") for f in RECT_FIELDS])
    touching = tiling.tiles_for_bounds(q, own, grid).select("q_col", "q_row", *[f"q_{f}" for f in RECT_FIELDS], *TILE, "tile_ord")
    near = light.join(touching, TILE)
    with_id = (
        near.where("feature_id IS NOT NULL")
        .groupBy("q_col", "q_row", "feature_id")
        .agg(F.min_by(F.struct(*TILE, "c_lon", "c_lat", *[f"q_{f}" for f in RECT_FIELDS]), "tile_ord").alias("r"))
        .select("q_col", "q_row", "feature_id", "r.*")
    )
    inside = (
        F.col("c_lon").between(F.col("q_min_lon"), F.col("q_max_lon"))
        & F.col("c_lat").between(F.col("q_min_lat"), F.col("q_max_lat"))
    )
    kept = with_id.where(inside).select("q_col", "q_row", "feature_id", *TILE)
    found = copies.join(kept, ["feature_id", *TILE]).withColumns({"tile_col": F.col("q_col"), "tile_row": F.col("q_row")})
    found = found.drop("q_col", "q_row").select(*copies.columns)
    loose = copies.where("feature_id IS NULL").join(touching.drop("tile_ord"), TILE)
    loose = loose.where(F.coalesce(c["lon"].between(F.col("q_min_lon"), F.col("q_max_lon")) & c["lat"].between(F.col("q_min_lat"), F.col("q_max_lat")), F.lit(True)))
    loose = loose.withColumns({"tile_col": F.col("q_col"), "tile_row": F.col("q_row")}).select(*copies.columns)
    return found.unionByName(loose)


def orphaned_features(copies: DataFrame, queried: DataFrame) -> DataFrame:
    """Count of features that no tile's query returns."""
    lost = copies.select("feature_id").distinct().join(queried.select("feature_id"), "feature_id", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("orphans"))


def build_all_tiles(
    copies: DataFrame,
    tiles: DataFrame,
    grid: tiling.Grid,
    rules: ClassifyRules | None = None,
    landcover_data: tuple[DataFrame, DataFrame] | None = None,
    min_area_sqm: float = D.BUILDER_MIN_AREA,
    row_origin: str = "north",
    single_tile_landcover_only: bool = False,
    refresh_parameters: bool = False,
    keep_water: bool = False,
    only: DataFrame | None = None,
) -> DataFrame:
    """Land-use polygons of all tiles (or of ``only`` some) in one job, the tile being a key.

    Roads and water count within the polygon's own tile query. Land cover
    (``(grids, pixels)``) is fused per tile after the parameters were set;
    ``refresh_parameters`` sets them again. ``single_tile_landcover_only``
    fuses only tiles that touch no other tile.
    """
    features = checkpointed(query_tile_features(copies, tiles, grid, only))
    polygons = D.polygons_from_vectors(features, grid.origin_lon, grid.origin_lat, min_area_sqm, by=tuple(TILE))
    polygons = C.assign_parameters(C.classify(polygons, rules, keep_water), rules)
    if landcover_data is None:
        return polygons
    grids, pixels = landcover_data
    if "min_lon" not in grids.columns:
        grids = grids.join(tiles.select(*TILE, *RECT_FIELDS), TILE)
    if single_tile_landcover_only:
        q = tiles.select(F.col("tile_col").alias("q_col"), F.col("tile_row").alias("q_row"), *[F.col(f).alias(f"q_{f}") for f in RECT_FIELDS])
        alone = tiling.tiles_for_bounds(q, tiles.select(*TILE, *RECT_FIELDS), grid).groupBy("q_col", "q_row").agg(F.count(F.lit(1)).alias("n"))
        alone = alone.where("n = 1").select(F.col("q_col").alias("tile_col"), F.col("q_row").alias("tile_row"))
        grids = grids.join(alone, TILE, "left_semi")
    if only is not None:
        grids = grids.join(only.select(*TILE), TILE, "left_semi")
    fused = landcover.fuse_landcover(polygons, pixels, grids, row_origin)
    return C.assign_parameters(fused, rules) if refresh_parameters else fused


def build_test_tile(copies: DataFrame, tiles: DataFrame, grid: tiling.Grid, rules: ClassifyRules | None = None, **options) -> DataFrame:
    """The catalog build for the tile with most features only.

    Only copies in the tiles that touch it are read and built.
    """
    best = checkpointed(tiling.busiest_tile(tiles).select(*TILE))
    return build_all_tiles(copies, tiles, grid, rules, only=best, **options)


def preprocess(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    grid: tiling.Grid,
    landcover_raster: tuple | None = None,
    dem_size: tuple[int, int] = (0, 0),
    skip_dem: bool = False,
    skip_landcover: bool = False,
    skip_validation: bool = False,
    placeholder_landcover: bool = False,
    lines: bool = False,
) -> DataFrame:
    """Tile a folder of inputs and write the result; returns the issues found.

    ``landcover_raster`` is ``(pixels, transform, width, height)`` of a decoded
    raster; there is no image codec here. ``lines`` reads newline-delimited
    features, the splittable form. The output holds ``features`` (a table
    partitioned by tile, which the tiled provider reads), ``landcover``, ``dem``,
    ``tiles`` and the ``manifest``, whose paths are checked against what is stored.
    Above ``sinks.tiles.FOLDERS`` tiles only a column of tiles has a folder; the
    paths of the manifest then name a tile's values in the table.
    """
    listed = discovery.discover_inputs(spark, input_dir)
    vector = [r[0] for r in listed.where("kind = 'geojson'").orderBy("path").collect()]  # file names
    if not vector:
        raise FileNotFoundError(f"no GeoJSON files in {input_dir}")
    features = (geojson.read_geojson_lines if lines else geojson.read_geojson)(spark, vector)
    # Parsed once: counting tiles, sampling their ranges and writing each read the rows.
    assigned = checkpointed(tiling.assign_tiles(tiling.with_bbox(features), grid))
    tiles = checkpointed(tiling.tile_table(assigned, grid))
    many = K.packed(tiles)
    (K.write_by_column if many else K.write_tiled_features)(assigned, f"{output_dir}/features", "overwrite")
    cover_folder = tiling.stored_folder("landcover") if many else K.landcover_folder()
    write_cover = K.write_by_column if many else K.write_landcover
    if not skip_dem and not listed.where("kind = 'dem'").isEmpty():
        dem_tiles, pixels = dem_source.read_dem(spark, input_dir, *dem_size, only=listed.where("kind = 'dem'"))
        K.write_dem_tiles(elevation.resample_tiles(tiles, dem_tiles, pixels), f"{output_dir}/dem", "overwrite")
        heights = spark.read.parquet(f"{output_dir}/dem").select(*TILE).distinct().withColumn("_dem", tiling.stored_folder("dem"))
        tiles = tiles.join(heights, TILE, "left").withColumn("dem", F.coalesce("_dem", F.lit(""))).drop("_dem")
    if not skip_landcover and landcover_raster is not None:
        pixels, transform, width, height = landcover_raster
        crops = landcover.crop_to_tiles(tiles, pixels, transform, width, height)
        write_cover(K.landcover_documents(crops, tiles, transform[1]), f"{output_dir}/landcover", "overwrite")
        covered = crops.select(*TILE).distinct().withColumn("_lc", cover_folder)
        tiles = tiles.join(covered, TILE, "left").withColumn("landcover", F.coalesce("_lc", F.lit(""))).drop("_lc")
    elif not skip_landcover and placeholder_landcover:
        crops = landcover.placeholder_landcover(tiles)
        write_cover(K.landcover_documents(crops, tiles, 0.0), f"{output_dir}/landcover", "overwrite")
        tiles = tiles.withColumn("landcover", cover_folder)
    tiles = checkpointed(tiles)
    K.write_manifest(tiles, grid, f"{output_dir}/manifest")
    tiles.write.mode("overwrite").parquet(f"{output_dir}/tiles")
    if skip_validation:
        return validate.tile_issues(tiles, tiles.select(*TILE, F.col("feature_count").alias("actual_count"))).where("false")
    return validate_output(spark, output_dir)


def validate_output(spark: SparkSession, output_dir: str) -> DataFrame:
    """Issues of a stored tiling output: its manifest against the files that are there."""
    docs = spark.read.text(f"{output_dir}/manifest", wholetext=True)
    _, tiles = manifest.parse_manifest(docs)
    stored = spark.read.parquet(f"{output_dir}/features").groupBy(*TILE).agg(F.count(F.lit(1)).alias("actual_count"))
    files = discovery.stored_folders(spark, output_dir)
    if not tiles.where("landcover LIKE 'landcover/tile_col=%'").isEmpty():
        cover = spark.read.parquet(f"{output_dir}/landcover").select(tiling.stored_folder("landcover").alias("path"))
        files = files.unionByName(cover.distinct())
    return validate.manifest_issues(docs).unionByName(validate.tile_issues(tiles, stored, files))

