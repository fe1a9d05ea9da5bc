"""Explicit schemas and fixed lookup values.

Nothing in the library infers a schema; every reader and operator states one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONLAT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RECT_FIELDS = ("min_lon", "min_lat", "max_lon", "max_lat")
RECT = T.StructType([T.StructField(f, T.DoubleType()) for f in RECT_FIELDS])

FEATURE = T.StructType(
    [
        T.StructField("geom_type", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("coords", T.ArrayType(LONLAT)),
        T.StructField("rings", T.ArrayType(T.ArrayType(LONLAT))),
        T.StructField("ring_is_outer", T.ArrayType(T.BooleanType())),
        T.StructField("props", T.MapType(T.StringType(), T.StringType())),
        T.StructField("source", T.StringType()),
    ]
)

TILE = T.StructType(
    [
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("geojson", T.StringType()),
        T.StructField("dem", T.StringType()),
        T.StructField("landcover", T.StringType()),
        T.StructField("bounds_geo", RECT),
        T.StructField("polygon_count", T.DoubleType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("projection", T.StringType()),
        T.StructField("epsg", T.IntegerType()),
        T.StructField("origin_lon", T.DoubleType()),
        T.StructField("origin_lat", T.DoubleType()),
        T.StructField("tile_size_m", T.DoubleType()),
        T.StructField("num_cols", T.IntegerType()),
        T.StructField("num_rows", T.IntegerType()),
        T.StructField("total_bounds", RECT),
        T.StructField("tiles", T.ArrayType(TILE)),
    ]
)

LANDCOVER_JSON = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("cell_size_m", T.DoubleType()),
        T.StructField("classes", T.ArrayType(T.IntegerType())),
        T.StructField("data", T.ArrayType(T.IntegerType())),
        T.StructField("bounds_geo", RECT),
    ]
)

DEM_PIXEL = T.StructType(
    [
        T.StructField("dem_id", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("px", T.IntegerType()),
        T.StructField("py", T.IntegerType()),
        T.StructField("elev", T.FloatType()),
    ]
)

# Columns of a stored land-use polygon, in order.
LAND_USE_POLYGON = T.StructType(
    [
        T.StructField("polygon_id", T.LongType()),
        T.StructField("tile_col", T.IntegerType()),
        T.StructField("tile_row", T.IntegerType()),
        T.StructField("land_use", T.StringType()),
        T.StructField("world_vertices", T.ArrayType(XY)),
        T.StructField("geo_vertices", T.ArrayType(LONLAT)),
        T.StructField("area_sqm", T.DoubleType()),
        T.StructField("center_x", T.DoubleType()),
        T.StructField("center_y", T.DoubleType()),
        T.StructField("avg_elevation", T.DoubleType()),
        T.StructField("avg_slope", T.DoubleType()),
        T.StructField("adjacent_main_road", T.BooleanType()),
        T.StructField("building_density", T.DoubleType()),
        T.StructField("vegetation_density", T.DoubleType()),
        T.StructField("min_floors", T.IntegerType()),
        T.StructField("max_floors", T.IntegerType()),
        T.StructField("building_setback", T.DoubleType()),
    ]
)

# --- fixed values ------------------------------------------------------------
# Land-use types in ordinal order; the ordinal is what the sampler emits.
LAND_USE_TYPES = (
    "Residential",
    "Commercial",
    "Industrial",
    "Forest",
    "Farmland",
    "Water",
    "Road",
    "OpenSpace",
    "Military",
    "Unknown",
)
FEATURE_CATEGORIES = (
    "Road",
    "River",
    "Coastline",
    "WaterBody",
    "Building",
    "LandUse",
    "Natural",
    "Other",
)
# Legend colours (r, g, b); any other type is (200, 200, 200).
LAND_USE_COLORS = {
    "Residential": (255, 235, 59),
    "Commercial": (244, 67, 54),
    "Industrial": (255, 152, 0),
    "Forest": (76, 175, 80),
    "Farmland": (139, 195, 74),
    "Water": (33, 150, 243),
    "Road": (158, 158, 158),
    "OpenSpace": (224, 224, 224),
    "Military": (120, 0, 0),
}
# ESA WorldCover v200 class codes.
WORLDCOVER_NAMES = {
    10: "Tree cover",
    20: "Shrubland",
    30: "Grassland",
    40: "Cropland",
    50: "Built-up",
    60: "Bare / sparse vegetation",
    70: "Snow and ice",
    80: "Permanent water bodies",
    90: "Herbaceous wetland",
    95: "Mangroves",
    100: "Moss and lichen",
}
# Raster code -> land-use type; unlisted codes are Unknown and do not vote.
WORLDCOVER_LAND_USE = {
    10: "Forest",
    20: "Forest",
    30: "OpenSpace",
    40: "Farmland",
    50: "Residential",
    60: "OpenSpace",
    70: "OpenSpace",
    80: "Water",
    90: "Water",
    95: "Forest",
    100: "OpenSpace",
}
# Terrain class -> land-use type.
TERRAIN_LAND_USE = {
    0: "Farmland",
    1: "Residential",
    2: "OpenSpace",
    3: "Residential",
    4: "Forest",
    5: "Water",
}
# Road class weights; a main road has weight >= 40.
ROAD_WEIGHTS = {
    "motorway": 100,
    "trunk": 80,
    "primary": 60,
    "secondary": 40,
    "tertiary": 20,
    "residential": 10,
    "unclassified": 5,
}
MAIN_ROAD_WEIGHT = 40
NODATA_ELEVATION = -9999.0
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class TerrainConfig:
    """Thresholds of terrain classification and zoning."""

    resolution_m: float = 30.0
    low_elevation_max: float = 50.0
    high_elevation_min: float = 300.0
    flat_max_slope: float = 5.0
    steep_min_slope: float = 15.0
    min_zone_area_sqm: float = 2000.0

    @property
    def cell_area_sqm(self) -> float:
        return self.resolution_m * self.resolution_m

    def with_rules(self, rules: "ClassifyRules") -> "TerrainConfig":
        """Supplied classification rules override the terrain thresholds."""
        return TerrainConfig(
            self.resolution_m,
            rules.low_elevation_max,
            rules.high_elevation_min,
            rules.flat_max_slope,
            rules.hill_min_slope,
            self.min_zone_area_sqm,
        )


@dataclass(frozen=True)
class ClassifyRules:
    """Thresholds and per-type parameters of the rule classifier."""

    small_block_max_area: float = 5000.0
    large_block_min_area: float = 20000.0
    flat_max_slope: float = 5.0
    hill_min_slope: float = 15.0
    low_elevation_max: float = 50.0
    high_elevation_min: float = 500.0
    building_density: dict[str, float] = field(default_factory=dict)
    vegetation_density: dict[str, float] = field(default_factory=dict)
    floor_range: dict[str, tuple[int, int]] = field(default_factory=dict)
