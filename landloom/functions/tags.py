"""Tag and code lookups as column expressions.

Lookups are literal maps of a fixed handful of entries, so they never shuffle
and never broadcast anything that could grow with the data.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from landloom import schema as S

# --- fixed values: tag values that decide a feature's category ----------------
RIVER_WATERWAYS = ("river", "stream", "canal", "drain", "ditch")
AREA_WATERWAYS = ("riverbank", "dock", "boatyard")
WATER_NATURALS = ("water", "bay", "strait")
LAND_NATURALS = ("wood", "scrub", "grassland", "heath", "wetland", "beach", "cliff", "peak")
WATER_LANDUSES = ("reservoir", "basin")
LANDUSE_TAG_TYPES = {
    "residential": "Residential",
    "commercial": "Commercial",
    "retail": "Commercial",
    "industrial": "Industrial",
    "forest": "Forest",
    "farmland": "Farmland",
    "farm": "Farmland",
    "military": "Military",
}
CATEGORY_TYPES = {"WaterBody": "Water", "Building": "Residential", "Natural": "Forest"}
DEM_FORMATS = {
    "tif": "GeoTIFF",
    "tiff": "GeoTIFF",
    "hgt": "GeoTIFF",
    "png": "HeightmapPNG",
    "r16": "HeightmapRAW",
    "raw": "HeightmapRAW",
}
# ------------------------------------------------------------------------------


def lookup(key: Column, table: dict) -> Column:
    """Value of a small fixed table for ``key``; NULL when absent."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def tag(props: Column, key: str) -> Column:
    return F.try_element_at(props, F.lit(key))


def infer_category(props: Column) -> Column:
    """Feature category from its tags, most specific rule first."""
    waterway, natural, landuse = tag(props, "waterway"), tag(props, "natural"), tag(props, "landuse")
    return (
        F.when(tag(props, "highway").isNotNull(), "Road")
        .when(waterway.isin(*RIVER_WATERWAYS), "River")
        .when(waterway.isin(*AREA_WATERWAYS), "WaterBody")
        .when(natural == "coastline", "Coastline")
        .when(natural.isin(*WATER_NATURALS), "WaterBody")
        .when(natural.isin(*LAND_NATURALS), "Natural")
        .when(tag(props, "water").isNotNull(), "WaterBody")
        .when(landuse.isin(*WATER_LANDUSES), "WaterBody")
        .when(landuse.isNotNull(), "LandUse")
        .when(tag(props, "building").isNotNull(), "Building")
        .otherwise("Other")
    )


def osm_landuse_to_type(landuse: Column) -> Column:
    """Land-use type of a ``landuse`` tag value; NULL tag is Unknown."""
    return F.when(landuse.isNull(), "Unknown").otherwise(F.coalesce(lookup(landuse, LANDUSE_TAG_TYPES), F.lit("OpenSpace")))


def category_to_type(category: Column, props: Column) -> Column:
    """First guess of a polygon's type from its category and tags."""
    return F.when(category == "LandUse", osm_landuse_to_type(tag(props, "landuse"))).otherwise(
        F.coalesce(lookup(category, CATEGORY_TYPES), F.lit("Unknown"))
    )


def road_weight(highway: Column, weights: dict[str, int] | None = None) -> Column:
    return lookup(highway, weights or S.ROAD_WEIGHTS)


def is_main_road(highway: Column, weights: dict[str, int] | None = None) -> Column:
    return F.coalesce(road_weight(highway, weights) >= S.MAIN_ROAD_WEIGHT, F.lit(False))


def land_use_ordinal(land_use: Column) -> Column:
    return lookup(land_use, {name: i for i, name in enumerate(S.LAND_USE_TYPES)})


def land_use_from_ordinal(ordinal: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(t) for t in S.LAND_USE_TYPES]), (ordinal + 1).cast("int"))


def land_use_color(land_use: Column) -> Column:
    """Struct ``(r, g, b)`` of the map legend."""
    parts = []
    for i, name in enumerate(("r", "g", "b")):
        channel = {t: rgb[i] for t, rgb in S.LAND_USE_COLORS.items()}
        parts.append(F.coalesce(lookup(land_use, channel), F.lit(200)).alias(name))
    return F.struct(*parts)


def worldcover_name(code: Column) -> Column:
    return lookup(code.cast("int"), S.WORLDCOVER_NAMES)


def worldcover_to_land_use(code: Column) -> Column:
    return F.coalesce(lookup(code.cast("int"), S.WORLDCOVER_LAND_USE), F.lit("Unknown"))


def terrain_class(elev: Column, slope: Column, cfg: S.TerrainConfig = S.TerrainConfig()) -> Column:
    """Terrain class 0..5 of a cell from elevation and slope."""
    low, high = elev <= cfg.low_elevation_max, elev >= cfg.high_elevation_min
    flat, steep = slope <= cfg.flat_max_slope, slope >= cfg.steep_min_slope
    return (
        F.when((elev < 0.5) & (slope < 1.0), 5)
        .when(high, F.when(steep, 4).otherwise(2))
        .when(low, F.when(flat, 0).otherwise(1))
        .when(flat, 2)
        .when(steep, 4)
        .otherwise(3)
    )


def terrain_to_land_use(terrain: Column) -> Column:
    return F.coalesce(lookup(terrain.cast("int"), S.TERRAIN_LAND_USE), F.lit("Unknown"))


def dem_format(extension: Column) -> Column:
    return F.coalesce(lookup(F.lower(extension), DEM_FORMATS), F.lit("GeoTIFF"))
