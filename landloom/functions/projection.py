"""Coordinate conversions as column expressions.

Three earth models are kept apart on purpose: a sphere of 6 371 000 m for the
local frame and great-circle distance, the WGS84 ellipsoid for UTM and tile
grids, and fixed metres-per-degree factors for raster grids.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPHERE_RADIUS_M = 6371000.0
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
E2 = WGS84_F * (2.0 - WGS84_F)
EP2 = E2 / (1.0 - E2)
K0 = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
CM_PER_M = 100.0

SERIES = ("full", "short")


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def _meridian_coefficients(series: str) -> tuple[float, float, float, float]:
    """Coefficients of phi, sin 2phi, sin 4phi, sin 6phi in the meridian arc.

    ``short`` leaves out the third power of the squared eccentricity.
    """
    if series not in SERIES:
        raise ValueError(f"series must be one of {SERIES}")
    cubic = 1.0 if series == "full" else 0.0
    e4, e6 = E2**2, cubic * E2**3
    return (
        1.0 - E2 / 4.0 - 3.0 * e4 / 64.0 - 5.0 * e6 / 256.0,
        3.0 * E2 / 8.0 + 3.0 * e4 / 32.0 + 45.0 * e6 / 1024.0,
        15.0 * e4 / 256.0 + 45.0 * e6 / 1024.0,
        35.0 * e6 / 3072.0,
    )


def _footpoint_coefficients(series: str) -> tuple[float, float, float, float]:
    e1 = (1.0 - math.sqrt(1.0 - E2)) / (1.0 + math.sqrt(1.0 - E2))
    last = 1097.0 * e1**4 / 512.0 if series == "full" else 0.0
    return (
        3.0 * e1 / 2.0 - 27.0 * e1**3 / 32.0,
        21.0 * e1**2 / 16.0 - 55.0 * e1**4 / 32.0,
        151.0 * e1**3 / 96.0,
        last,
    )


def utm_zone(lon) -> Column:
    """UTM zone number; NULL outside 1..60."""
    zone = (F.floor((_col(lon) + 180.0) / 6.0) + 1).cast("int")
    return F.when(zone.between(1, 60), zone)


def central_meridian(zone: Column) -> Column:
    return zone.cast("double") * 6.0 - 183.0


def wgs84_to_utm(lon, lat, zone=None, northern: bool | None = None, series: str = "full") -> Column:
    """Struct ``(easting, northing, zone, north)``.

    ``zone`` fixes the zone for a whole data set (a tile grid must not change
    zone at its edge). ``northern`` fixes the hemisphere in the same way; by
    default each point uses the sign of its own latitude.
    """
    lon, lat = _col(lon), _col(lat)
    zone_col = utm_zone(lon) if zone is None else (zone if isinstance(zone, Column) else F.lit(int(zone)))
    m0, m2, m4, m6 = _meridian_coefficients(series)
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = F.lit(WGS84_A) / F.sqrt(1.0 - E2 * sin * sin)
    t = tan * tan
    c = EP2 * cos * cos
    a = F.radians(lon - central_meridian(zone_col)) * cos
    a2 = a * a
    arc = WGS84_A * (m0 * phi - m2 * F.sin(2.0 * phi) + m4 * F.sin(4.0 * phi) - m6 * F.sin(6.0 * phi))
    easting = (
        K0 * nu * a * (1.0 + a2 * ((1.0 - t + c) / 6.0 + a2 * (5.0 - 18.0 * t + t * t + 72.0 * c - 58.0 * EP2) / 120.0))
        + FALSE_EASTING
    )
    northing = K0 * (
        arc
        + nu
        * tan
        * a2
        * (
            0.5
            + a2
            * (
                (5.0 - t + 9.0 * c + 4.0 * c * c) / 24.0
                + a2 * (61.0 - 58.0 * t + t * t + 600.0 * c - 330.0 * EP2) / 720.0
            )
        )
    )
    is_north = (lat >= 0.0) if northern is None else F.lit(bool(northern))
    northing = northing + F.when(is_north, 0.0).otherwise(FALSE_NORTHING_SOUTH)
    return F.struct(
        easting.alias("easting"), northing.alias("northing"), zone_col.alias("zone"), is_north.alias("north")
    )


def with_utm(
    df: DataFrame, points: dict[str, tuple[str, str]], zone: int, northern: bool | None = None, series: str = "full"
) -> DataFrame:
    """Add ``<name>_e, <name>_n`` for each named pair of lon, lat expressions.

    The same projection as :func:`wgs84_to_utm`, staged over flat columns: each
    intermediate is computed once and the whole chain stays in one small
    generated stage, which matters when several points of a row are projected.
    """
    m0, m2, m4, m6 = (f"{m!r}D" for m in _meridian_coefficients(series))
    stages: list[dict[str, str]] = [{}, {}, {}, {}, {}]
    for name, (lon, lat) in points.items():
        v = f"_{name}_"
        north = f"{v}lat >= 0D" if northern is None else str(bool(northern)).lower()
        stages[0] |= {f"{v}lat": lat, f"{v}p": f"radians({lat})", f"{v}dl": f"radians({lon} - {zone * 6.0 - 183.0!r}D)"}
        stages[1] |= {f"{v}sin": f"sin({v}p)", f"{v}cos": f"cos({v}p)", f"{v}tan": f"tan({v}p)"}
        stages[2] |= {
            f"{v}nu": f"{WGS84_A!r}D / sqrt(1D - {E2!r}D * {v}sin * {v}sin)",
            f"{v}t": f"{v}tan * {v}tan",
            f"{v}c": f"{EP2!r}D * {v}cos * {v}cos",
            f"{v}a": f"{v}dl * {v}cos",
        }
        stages[3] |= {f"{v}a2": f"{v}a * {v}a"}
        t, c, a2, p = f"{v}t", f"{v}c", f"{v}a2", f"{v}p"
        arc = f"{WGS84_A!r}D * ({m0} * {p} - {m2} * sin(2D * {p}) + {m4} * sin(4D * {p}) - {m6} * sin(6D * {p}))"
        east5 = f"(5D - 18D * {t} + {t} * {t} + 72D * {c} - {58.0 * EP2!r}D) / 120D"
        north4 = f"(5D - {t} + 9D * {c} + 4D * {c} * {c}) / 24D"
        north6 = f"(61D - 58D * {t} + {t} * {t} + 600D * {c} - {330.0 * EP2!r}D) / 720D"
        stages[4] |= {
            f"{name}_e": f"{K0!r}D * {v}nu * {v}a * (1D + {a2} * ((1D - {t} + {c}) / 6D + {a2} * {east5})) + {FALSE_EASTING!r}D",
            f"{name}_n": f"{K0!r}D * ({arc} + {v}nu * {v}tan * {a2} * (0.5D + {a2} * ({north4} + {a2} * {north6})))"
            f" + CASE WHEN {north} THEN 0D ELSE {FALSE_NORTHING_SOUTH!r}D END",
        }
    kept = df.columns
    for stage in stages:
        df = df.selectExpr("*", *[f"{text} AS {name}" for name, text in stage.items()])
    return df.select(*kept, *stages[4])


@functools.lru_cache(maxsize=64)
def _origin(spark: SparkSession, lon: float, lat: float, zone: int) -> tuple[float, float]:
    """Projected grid origin, computed by the engine that projects the data."""
    one = spark.range(1).selectExpr(f"{float(lon)!r}D + 0D * id AS lon", f"{float(lat)!r}D + 0D * id AS lat")
    row = with_utm(one, {"o": ("lon", "lat")}, zone, lat >= 0.0).first()
    return row["o_e"], row["o_n"]


def with_tiles(
    df: DataFrame,
    points: dict[str, tuple[str, str]],
    tile_size_m: float,
    origin_lon: float,
    origin_lat: float,
    per_point_hemisphere: bool = False,
) -> DataFrame:
    """Add ``<name>_col, <name>_row`` for each named pair of lon, lat expressions.

    Floor of the UTM offset from the origin. The hemisphere is that of the
    origin, so a grid that touches the equator stays continuous;
    ``per_point_hemisphere`` restores the jump there.
    """
    zone = int(math.floor((origin_lon + 180.0) / 6.0)) + 1
    east, north = _origin(df.sparkSession, origin_lon, origin_lat, zone)
    df = with_utm(df, points, zone, None if per_point_hemisphere else origin_lat >= 0.0)
    tiles = []
    for name in points:
        tiles.append(f"CAST(floor(({name}_e - {east!r}D) / {float(tile_size_m)!r}D) AS INT) AS {name}_col")
        tiles.append(f"CAST(floor(({name}_n - {north!r}D) / {float(tile_size_m)!r}D) AS INT) AS {name}_row")
    return df.selectExpr("*", *tiles).drop(*[f"{n}_{k}" for n in points for k in "en"])


def utm_to_wgs84(easting, northing, zone, north=True, series: str = "full") -> Column:
    """Struct ``(lon, lat)`` from UTM coordinates."""
    zone_col = zone if isinstance(zone, Column) else F.lit(int(zone))
    north_col = north if isinstance(north, Column) else F.lit(bool(north))
    m0 = _meridian_coefficients(series)[0]
    f2, f4, f6, f8 = _footpoint_coefficients(series)
    y = _col(northing) - F.when(north_col, 0.0).otherwise(FALSE_NORTHING_SOUTH)
    mu = y / K0 / (WGS84_A * m0)
    phi = mu + f2 * F.sin(2.0 * mu) + f4 * F.sin(4.0 * mu) + f6 * F.sin(6.0 * mu) + f8 * F.sin(8.0 * mu)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    w = 1.0 - E2 * sin * sin
    nu = F.lit(WGS84_A) / F.sqrt(w)
    rho = WGS84_A * (1.0 - E2) / (w * F.sqrt(w))
    t = tan * tan
    c = EP2 * cos * cos
    d = (_col(easting) - FALSE_EASTING) / (nu * K0)
    d2 = d * d
    lat = phi - nu * tan / rho * d2 * (
        0.5
        - d2 * (5.0 + 3.0 * t + 10.0 * c - 4.0 * c * c - 9.0 * EP2) / 24.0
        + d2 * d2 * (61.0 + 90.0 * t + 298.0 * c + 45.0 * t * t - 252.0 * EP2 - 3.0 * c * c) / 720.0
    )
    dlon = (
        d
        * (
            1.0
            - d2 * (1.0 + 2.0 * t + c) / 6.0
            + d2 * d2 * (5.0 - 2.0 * c + 28.0 * t - 3.0 * c * c + 8.0 * EP2 + 24.0 * t * t) / 120.0
        )
        / cos
    )
    valid = zone_col.between(1, 60)
    return F.when(
        valid,
        F.struct((central_meridian(zone_col) + F.degrees(dlon)).alias("lon"), F.degrees(lat).alias("lat")),
    )


def meters_per_degree_lat() -> float:
    return math.pi * WGS84_A / 180.0


def meters_per_degree_lon(lat) -> Column:
    return F.cos(F.radians(_col(lat))) * meters_per_degree_lat()


def tile_bounds(col: Column, row: Column, tile_size_m: float, origin_lon: float, origin_lat: float) -> Column:
    """Geographic rectangle of a tile, linear in degrees at the origin."""
    dlon = F.lit(float(tile_size_m)) / meters_per_degree_lon(origin_lat)
    dlat = float(tile_size_m) / meters_per_degree_lat()
    return F.struct(
        (origin_lon + col * dlon).alias("min_lon"),
        (origin_lat + row * F.lit(dlat)).alias("min_lat"),
        (origin_lon + (col + 1) * dlon).alias("max_lon"),
        (origin_lat + (row + 1) * F.lit(dlat)).alias("max_lat"),
    )


def _local_scale(origin_lat: float) -> tuple[Column, float]:
    per_degree = math.pi / 180.0 * SPHERE_RADIUS_M
    return F.cos(F.radians(F.lit(float(origin_lat)))) * per_degree, per_degree


def geo_to_world(lon, lat, origin_lon: float, origin_lat: float) -> Column:
    """Struct ``(x, y)`` in centimetres, x east and y north of the origin."""
    per_lon, per_lat = _local_scale(origin_lat)
    return F.struct(
        ((_col(lon) - origin_lon) * per_lon * CM_PER_M).alias("x"),
        ((_col(lat) - origin_lat) * per_lat * CM_PER_M).alias("y"),
    )


def world_to_geo(x, y, origin_lon: float | None, origin_lat: float | None) -> Column:
    """Inverse of :func:`geo_to_world`; an unset origin maps to (0, 0)."""
    if origin_lon is None or origin_lat is None:
        return F.struct(F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    per_lon, per_lat = _local_scale(origin_lat)
    return F.struct(
        (origin_lon + _col(x) / CM_PER_M / per_lon).alias("lon"),
        (origin_lat + _col(y) / CM_PER_M / per_lat).alias("lat"),
    )


def geo_array_to_world(coords: Column, origin_lon: float, origin_lat: float) -> Column:
    return F.transform(coords, lambda p: geo_to_world(p["lon"], p["lat"], origin_lon, origin_lat))


def world_array_to_geo(vertices: Column, origin_lon: float, origin_lat: float) -> Column:
    return F.transform(vertices, lambda p: world_to_geo(p["x"], p["y"], origin_lon, origin_lat))


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_col, (lon1, lat1, lon2, lat2))
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    sin_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    a = sin_lat * sin_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * sin_lon * sin_lon
    return SPHERE_RADIUS_M * 2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a))


def rect_valid(rect: Column) -> Column:
    return (rect["max_lon"] > rect["min_lon"]) & (rect["max_lat"] > rect["min_lat"])


def rect_center(rect: Column) -> Column:
    return F.struct(
        ((rect["min_lon"] + rect["max_lon"]) / 2.0).alias("lon"),
        ((rect["min_lat"] + rect["max_lat"]) / 2.0).alias("lat"),
    )


def world_to_cell(x: Column, y: Column, cell_size_cm: float = 50000.0) -> Column:
    return F.struct(
        F.floor(x / float(cell_size_cm)).cast("int").alias("cell_x"),
        F.floor(y / float(cell_size_cm)).cast("int").alias("cell_y"),
    )


def tile_id(col: Column, row: Column) -> Column:
    return F.concat(F.lit("tile_"), col.cast("string"), F.lit("_"), row.cast("string"))


def parse_projection(name: Column) -> Column:
    """Struct ``(zone, north)`` from ``UTM<zone><N|S>``.

    Only a trailing letter sets the hemisphere: trailing text after it keeps
    the zone and falls back to north.
    """
    is_utm = name.startswith("UTM")
    digits = F.regexp_extract(name, r"^UTM(\d+)", 1)
    zone = F.when(is_utm & (digits != ""), digits.cast("int")).otherwise(F.lit(0))
    return F.struct(zone.alias("zone"), (~(is_utm & name.endswith("S"))).alias("north"))


def epsg_code(zone: Column, north: Column) -> Column:
    return F.when(north, F.lit(32600)).otherwise(F.lit(32700)) + zone


def projection_name(zone: Column, north: Column) -> Column:
    return F.concat(F.lit("UTM"), zone.cast("string"), F.when(north, "N").otherwise("S"))
