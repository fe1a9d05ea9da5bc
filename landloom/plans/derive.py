"""Deriving classified land-use polygons from features and elevation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import projection as P
from landloom.functions import tags as K
from landloom.operators import classify as C
from landloom.operators import cutting, elevation, spatial, terrain, zones
from landloom.operators import filters as Fl
from landloom.operators.stats import feature_bounds
from landloom.schema import ClassifyRules, TerrainConfig
from landloom.session import once

MAIN_ROAD_FACTOR = 1.5
FLAT_WATER_EDGE_DEG = 1e-4
DERIVER_MIN_AREA = 500.0
BUILDER_MIN_AREA = 800.0


def with_world_geometry(areas: DataFrame, origin_lon: float, origin_lat: float) -> DataFrame:
    """Add ``world_vertices, area_sqm, center_x, center_y`` to area features."""
    df = once(areas, world_vertices=P.geo_array_to_world(F.col("coords"), origin_lon, origin_lat))
    df = once(df, area_sqm=G.area_sqm(F.col("world_vertices")), _c=G.vertex_mean(F.col("world_vertices"), "x", "y"))
    return df.withColumns({"center_x": F.col("_c.x"), "center_y": F.col("_c.y")}).drop("_c")


def flag_main_roads(
    polygons: DataFrame, roads: DataFrame, origin_lon: float, origin_lat: float, by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``adjacent_main_road``: a main-road vertex lies near the centre.

    Near means closer than 1.5 times the side of a square of the same area.
    """
    v = Fl.main_roads(roads).select(*by, F.explode("coords").alias("p"))
    v = v.select(*by, P.geo_to_world(F.col("p.lon"), F.col("p.lat"), origin_lon, origin_lat).alias("w")).select(*by, "w.*")
    sized = polygons.withColumn("_radius", F.sqrt("area_sqm") * 100.0 * MAIN_ROAD_FACTOR)
    return spatial.flag_within_radius(sized, v, "adjacent_main_road", radius="_radius", by=by).drop("_radius")


def mark_water(polygons: DataFrame, water: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Set polygons whose vertex mean lies in a water body to Water."""
    areas = Fl.area_features(Fl.by_category(water, "WaterBody"))
    c = G.vertex_mean(F.col("geo_vertices"), "lon", "lat")
    centred = polygons.withColumns({"_lon": c["lon"], "_lat": c["lat"]})
    flagged = spatial.flag_inside_any(
        centred, areas, "_wet", "_lon", "_lat", min_edge_height=FLAT_WATER_EDGE_DEG, by=by
    )
    hit = F.col("_wet") & (F.col("land_use") != "Water")
    return flagged.withColumns(
        {
            "building_density": F.when(hit, 0.0).otherwise(F.col("building_density")),
            "vegetation_density": F.when(hit, 0.0).otherwise(F.col("vegetation_density")),
            "land_use": F.when(hit, "Water").otherwise(F.col("land_use")),
        }
    ).drop("_wet", "_lon", "_lat")


def polygons_from_vectors(
    features: DataFrame,
    origin_lon: float,
    origin_lat: float,
    min_area_sqm: float = BUILDER_MIN_AREA,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Polygons straight from area features, typed by their tags.

    The polygon keeps its feature's id. ``by`` limits roads and water to the
    same group (for example the same tile) as the polygon.
    """
    areas = with_world_geometry(Fl.area_features(features), origin_lon, origin_lat)
    typed = Fl.min_area(areas, min_area_sqm).select(
        F.col("feature_id").alias("polygon_id"),
        *by,
        K.category_to_type(F.col("category"), F.col("props")).alias("land_use"),
        "world_vertices",
        F.col("coords").alias("geo_vertices"),
        "area_sqm",
        "center_x",
        "center_y",
        F.lit(0.0).alias("avg_elevation"),
        F.lit(0.0).alias("avg_slope"),
    )
    flagged = flag_main_roads(C.with_defaults(typed), features, origin_lon, origin_lat, by)
    return mark_water(flagged, features, by)


def analyze_terrain(
    cells: DataFrame, cfg: TerrainConfig = TerrainConfig(), parity_nodata: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(cells, zones)``: slope, class and merged zone per cell, and zone rows.

    Zones below the minimum area are left out of the zone rows.
    """
    classed = terrain.classify_cells(terrain.slope_aspect(cells, cfg.resolution_m), cfg, parity_nodata)
    merged = zones.merged_cells(zones.label_zones(classed), cfg)
    stats = zones.zone_statistics(merged, cfg)
    return merged, stats.where(F.col("area_sqm") >= cfg.min_zone_area_sqm)


def polygons_from_zones(
    cells: DataFrame,
    zone_rows: DataFrame,
    features: DataFrame,
    bounds,
    shape: tuple[int, int],
    origin_lon: float,
    origin_lat: float,
    min_area_sqm: float = BUILDER_MIN_AREA,
) -> DataFrame:
    """Polygons from zone outlines cut by roads, rivers and coastlines.

    Holes of a zone stay holes of its pieces (``world_holes``, ``geo_holes``) and
    do not count to their area.
    """
    outlines = zones.zone_outlines(cells, bounds, shape, origin_lon, origin_lat)
    kept = outlines.join(zone_rows.select("grid_id", "zone_id"), ["grid_id", "zone_id"], "left_semi")
    segments = cutting.cut_segments(features, origin_lon, origin_lat)
    key = F.to_json(F.struct("grid_id", "zone_id", "outer_no")).alias("polygon_id")
    kept = kept.select(key, "grid_id", "zone_id", "world_vertices", "world_holes")
    pieces = cutting.cut_polygons(kept, segments)
    info = zone_rows.select("grid_id", "zone_id", "avg_elevation", "avg_slope", "terrain_class")
    info = kept.select("polygon_id", "grid_id", "zone_id").join(info, ["grid_id", "zone_id"])
    sized = pieces.join(info, "polygon_id").withColumns(
        {"area_sqm": G.net_area_sqm(F.col("world_vertices"), F.col("world_holes")), "_c": G.vertex_mean(F.col("world_vertices"), "x", "y")}
    )
    typed = Fl.min_area(sized, min_area_sqm).select(
        F.xxhash64("piece_id").alias("polygon_id"),
        "grid_id",
        "zone_id",
        "piece_id",
        K.terrain_to_land_use(F.col("terrain_class")).alias("land_use"),
        "world_vertices",
        P.world_array_to_geo(F.col("world_vertices"), origin_lon, origin_lat).alias("geo_vertices"),
        "world_holes",
        F.transform("world_holes", lambda h: P.world_array_to_geo(h, origin_lon, origin_lat)).alias("geo_holes"),
        "area_sqm",
        F.col("_c.x").alias("center_x"),
        F.col("_c.y").alias("center_y"),
        "avg_elevation",
        "avg_slope",
    )
    return mark_water(flag_main_roads(C.with_defaults(typed), features, origin_lon, origin_lat), features)


def derive(
    spark: SparkSession,
    features: DataFrame,
    origin_lon: float,
    origin_lat: float,
    rules: ClassifyRules | None = None,
    dem: tuple[DataFrame, DataFrame] | None = None,
    bounds=None,
    cfg: TerrainConfig = TerrainConfig(),
    min_area_sqm: float = BUILDER_MIN_AREA,
    keep_water: bool = False,
) -> DataFrame:
    """Features (and elevation ``(tiles, pixels)``, if any) to classified polygons.

    With elevation the terrain is zoned and cut by the vectors; without it the
    area features become polygons. Missing bounds are taken from the features.
    """
    polygons = None
    if dem is not None:
        if bounds is None or not (bounds[2] > bounds[0] and bounds[3] > bounds[1]):
            row = feature_bounds(features).first()
            bounds = tuple(row) if row else None
        if bounds is not None:
            used = cfg.with_rules(rules) if rules else cfg
            shape = elevation.grid_shape(bounds, used.resolution_m)
            if zones.shape_ok(*shape):
                grid = elevation.elevation_grid(spark, *dem, bounds, used.resolution_m)
                cells, zone_rows = analyze_terrain(grid.select("grid_id", "x", "y", "elev"), used)
                polygons = polygons_from_zones(
                    cells, zone_rows, features, bounds, shape, origin_lon, origin_lat, min_area_sqm
                )
    if polygons is None:
        polygons = polygons_from_vectors(features, origin_lon, origin_lat, min_area_sqm)
    return C.assign_parameters(C.classify(polygons, rules, keep_water), rules)
