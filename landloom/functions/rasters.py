"""Raster metadata and pixel-value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
GRAY_MAX_ELEVATION_M = 8848.0
GRID_M_PER_DEG_LON = 111320.0
GRID_M_PER_DEG_LAT = 110540.0
# ------------------------------------------------------------------------------


def pixel_size(span: Column, width: Column) -> Column:
    """Degrees per pixel, 0 for an empty axis."""
    return F.when(width > 0, span / width).otherwise(F.lit(0.0))


def landcover_cell_size_m(pixel_degrees: Column, min_lat: Column, max_lat: Column) -> Column:
    mid = F.radians((min_lat + max_lat) / 2.0)
    return F.round(F.abs(pixel_degrees) * GRID_M_PER_DEG_LON * F.cos(mid), 2)


def decode_height(r: Column, g: Column, b: Column, encoding: str, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Elevation of an RGB height-map pixel.

    ``gray`` spreads the red channel over 0..8848 m, ``terrain_rgb`` is the
    public 0.1 m encoding over three channels, ``linear`` is red*scale+offset.
    """
    r, g, b = r.cast("double"), g.cast("double"), b.cast("double")
    if encoding == "gray":
        return r / 255.0 * GRAY_MAX_ELEVATION_M
    if encoding == "terrain_rgb":
        return (r * 65536.0 + g * 256.0 + b) * 0.1 - 10000.0
    if encoding == "linear":
        return r * float(scale) + float(offset)
    raise ValueError(f"unknown height encoding {encoding!r}")


def srtm_bounds(name: Column) -> Column:
    """1x1 degree rectangle from a name such as ``N31E121``; NULL otherwise."""
    pattern = r"^([NS])(.{2})([EW])(.{3})"
    sign_lat = F.when(F.regexp_extract(name, pattern, 1) == "N", 1.0).otherwise(-1.0)
    sign_lon = F.when(F.regexp_extract(name, pattern, 3) == "E", 1.0).otherwise(-1.0)

    def leading_int(text: Column) -> Column:
        digits = F.regexp_extract(text, r"^\s*(\d+)", 1)
        return F.when(digits == "", 0.0).otherwise(digits.cast("double"))

    lat = sign_lat * leading_int(F.regexp_extract(name, pattern, 2))
    lon = sign_lon * leading_int(F.regexp_extract(name, pattern, 4))
    return F.when(
        name.rlike(pattern),
        F.struct(
            lon.alias("min_lon"), lat.alias("min_lat"), (lon + 1.0).alias("max_lon"), (lat + 1.0).alias("max_lat")
        ),
    )


def manifest_valid(tile_count: Column, tile_size_m: Column) -> Column:
    return (tile_count > 0) & (tile_size_m > 0)


def landcover_valid(width: Column, height: Column, length: Column) -> Column:
    return (width > 0) & (height > 0) & (length == width * height)
