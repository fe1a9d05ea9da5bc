"""Predicates over features, polygons and tiles.

All are plain ``where`` clauses so Catalyst can push them to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import projection as P
from landloom.functions import tags as K

AREA_TYPES = ("Polygon", "MultiPolygon")


def by_geometry_type(features: DataFrame, geom_type: str) -> DataFrame:
    return features.where(F.col("geom_type") == geom_type)


def by_property(features: DataFrame, key: str, value: str) -> DataFrame:
    return features.where(K.tag(F.col("props"), key) == value)


def by_category(features: DataFrame, category: str) -> DataFrame:
    return features.where(F.col("category") == category)


def categorize(features: DataFrame) -> dict[str, DataFrame]:
    """The four categories the derivation consumes, as lazy views."""
    return {c: by_category(features, c) for c in ("Road", "River", "Coastline", "WaterBody")}


def _rect_ok(bounds) -> bool:
    return bounds is not None and bounds[2] > bounds[0] and bounds[3] > bounds[1]


def _inside(lon: Column, lat: Column, bounds) -> Column:
    return lon.between(float(bounds[0]), float(bounds[2])) & lat.between(float(bounds[1]), float(bounds[3]))


def any_vertex_in_bounds(features: DataFrame, bounds) -> DataFrame:
    """Features with a vertex in the rectangle; an invalid rectangle keeps all."""
    if not _rect_ok(bounds):
        return features
    return features.where(F.exists("coords", lambda p: _inside(p["lon"], p["lat"], bounds)))


def centroid_in_bounds(features: DataFrame, min_lon, min_lat, max_lon, max_lat) -> DataFrame:
    """Features whose vertex mean is in the rectangle; no vertices is kept.

    The limits may be numbers or columns (the bounds of the row's own tile).
    """
    c = G.vertex_mean(F.col("coords"), "lon", "lat")
    lo_x, lo_y, hi_x, hi_y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (min_lon, min_lat, max_lon, max_lat))
    inside = (c["lon"] >= lo_x) & (c["lon"] <= hi_x) & (c["lat"] >= lo_y) & (c["lat"] <= hi_y)
    empty = F.col("coords").isNull() | (F.size("coords") == 0)
    return features.where(empty | F.coalesce(inside, F.lit(False)))


def area_features(features: DataFrame) -> DataFrame:
    """Only area geometries with at least three vertices."""
    return features.where(F.col("geom_type").isin(*AREA_TYPES) & (F.size("coords") >= 3))


def min_area(polygons: DataFrame, min_area_sqm: float) -> DataFrame:
    return polygons.where(F.col("area_sqm") >= float(min_area_sqm))


def without_slivers(polygons: DataFrame, min_area_sqcm: float = 100.0) -> DataFrame:
    """Drop cutting leftovers: under three vertices or at most 100 cm2."""
    ring = F.col("world_vertices")
    return polygons.where((F.size(ring) >= 3) & (F.abs(G.signed_area(ring)) > float(min_area_sqcm)))


def by_land_use(polygons: DataFrame, types: list[str] | str | None) -> DataFrame:
    """Polygons of the given types; an empty list means all."""
    if isinstance(types, str):
        types = [types]
    return polygons if not types else polygons.where(F.col("land_use").isin(*types))


def center_in_world_box(
    polygons: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, cell_size_cm: float = 50000.0
) -> DataFrame:
    """Polygons whose centre is in the box.

    When the table carries ``cell_x, cell_y`` the cell range comes first: those
    are plain integer comparisons that prune Parquet row groups.
    """
    df = polygons
    if "cell_x" in polygons.columns:
        lo_x, hi_x = int(min_x // cell_size_cm), int(max_x // cell_size_cm)
        lo_y, hi_y = int(min_y // cell_size_cm), int(max_y // cell_size_cm)
        df = df.where(F.col("cell_x").between(lo_x, hi_x) & F.col("cell_y").between(lo_y, hi_y))
    return df.where(
        F.col("center_x").between(float(min_x), float(max_x)) & F.col("center_y").between(float(min_y), float(max_y))
    )


def load_radius_box(center_x: float, center_y: float, tile_size_m: float = 1024.0, radius: int = 3):
    """World box of ``radius`` tiles around a point, in centimetres."""
    half = tile_size_m * P.CM_PER_M * radius
    return center_x - half, center_y - half, center_x + half, center_y + half


def in_load_radius(
    polygons: DataFrame, center_x: float, center_y: float, tile_size_m: float = 1024.0, radius: int = 3
) -> DataFrame:
    return center_in_world_box(polygons, *load_radius_box(center_x, center_y, tile_size_m, radius))


def tiles_in_bounds(tiles: DataFrame, bounds) -> DataFrame:
    """Tiles whose rectangle touches the bounds (shared edges count)."""
    lo_x, lo_y, hi_x, hi_y = map(float, bounds)
    return tiles.where(
        (F.col("max_lon") >= lo_x) & (F.col("min_lon") <= hi_x) & (F.col("max_lat") >= lo_y) & (F.col("min_lat") <= hi_y)
    )


def find_tile(tiles: DataFrame, col: int, row: int) -> DataFrame:
    """The tile at a grid position; the first one in manifest order."""
    return tiles.where((F.col("tile_col") == col) & (F.col("tile_row") == row)).orderBy("tile_ord").limit(1)


def tiles_in_world_box(tiles: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, tile_size_m: float):
    """Registered tiles under a world box; an unset tile size returns all.

    Integer ranges on the partition columns, so a partitioned table is pruned.
    """
    if tile_size_m <= 0:
        return tiles
    size = tile_size_m * P.CM_PER_M
    return tiles.where(
        F.col("tile_col").between(int(min_x // size), int(max_x // size))
        & F.col("tile_row").between(int(min_y // size), int(max_y // size))
    )


def main_roads(features: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    return by_category(features, "Road").where(K.is_main_road(K.tag(F.col("props"), "highway"), weights))


