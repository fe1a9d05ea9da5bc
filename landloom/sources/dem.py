"""Elevation raster readers.

Files arrive as ``binaryFile`` rows and are decoded in batches of raster rows;
``decode`` also accepts any DataFrame with ``path, content``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom import schema as S
from landloom.functions import rasters as R

# --- fixed values -------------------------------------------------------------
HGT_SIDES = (3601, 1201)
VOID = -32768
EXTENSIONS = ("tif", "tiff", "hgt", "png", "r16", "raw")
# ------------------------------------------------------------------------------
ROWS_PER_BATCH = 64
PIXEL_SCHEMA = "dem_id string, width int, height int, px int, py int, elev float"


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]+)?$", 1)


def _layout(ext: str, content: bytes, width: int, height: int):
    """``(dtype, offset, width, height, has_void)`` of a raster, or a reason."""
    if ext == "hgt":
        for side in HGT_SIDES:
            if len(content) == side * side * 2:
                return ">i2", 0, side, side, True
        return "size is neither 3601 nor 1201 square"
    if ext in ("r16", "raw"):
        if width <= 0 or height <= 0:
            side = round(math.sqrt(len(content) // 2))
            if side * side != len(content) // 2:
                return "cannot infer a square size"
            width = height = side
        return "<u2", 0, width, height, False
    if ext == "png":
        return "PNG pixels need an image codec; decode them elsewhere and use decode_height"
    if content[:2] not in (b"II", b"MM"):
        return "not a TIFF file"
    if width <= 0 or height <= 0:
        return "width and height must be given"
    if len(content) < width * height * 2:
        return "shorter than width x height"
    order = "<i2" if content[:2] == b"II" else ">i2"
    return order, len(content) - width * height * 2, width, height, True


def decode(files: DataFrame, width: int = 0, height: int = 0) -> DataFrame:
    """Pixels of raster files ``path, content``; undecodable files give none.

    HGT is big-endian int16 with a fixed square size, RAW little-endian uint16
    and square unless a size is given, TIFF the last ``width * height`` int16
    values of the file. Void samples become NULL. Row 0 is in the north.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                layout = _layout(ext, content, width, height)
                if isinstance(layout, str):
                    continue
                dtype, offset, w, h, has_void = layout
                count = min(w * h, (len(content) - offset) // 2)
                values = np.frombuffer(content, dtype=dtype, count=count, offset=offset)
                for top in range(0, h, ROWS_PER_BATCH):
                    part = values[top * w : (top + ROWS_PER_BATCH) * w]
                    index = np.arange(len(part)) + top * w
                    elev = part.astype(np.float32)
                    if has_void:
                        elev = np.where(part == VOID, np.float32(np.nan), elev)
                    yield pd.DataFrame(
                        {
                            "dem_id": path,
                            "width": np.int32(w),
                            "height": np.int32(h),
                            "px": (index % w).astype(np.int32),
                            "py": (index // w).astype(np.int32),
                            "elev": elev,
                        }
                    )

    rows = files.select("path", file_extension(F.col("path")).alias("ext"), "content").mapInPandas(run, PIXEL_SCHEMA)
    return rows.withColumn("elev", F.when(~F.isnan("elev"), F.col("elev")))


def headers(files: DataFrame, width: int = 0, height: int = 0) -> DataFrame:
    """``dem_id, width, height, reason`` per file, without emitting pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                layout = _layout(ext, content, width, height)
                bad = isinstance(layout, str)
                found.append((path, 0 if bad else layout[2], 0 if bad else layout[3], layout if bad else None))
            yield pd.DataFrame(found, columns=["dem_id", "width", "height", "reason"])

    return files.select("path", file_extension(F.col("path")).alias("ext"), "content").mapInPandas(
        run, "dem_id string, width int, height int, reason string"
    )


def rejects(files: DataFrame, width: int = 0, height: int = 0) -> DataFrame:
    """Files that cannot be decoded: ``path, reason``."""
    return headers(files, width, height).where("reason IS NOT NULL").select(F.col("dem_id").alias("path"), "reason")


def list_dem_files(spark: SparkSession, path: str) -> DataFrame:
    """Raster files under a folder (recursive) or a single file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(file_extension(F.col("path")).isin(*EXTENSIONS))


def tile_table(heads: DataFrame, bounds: tuple | None = None) -> DataFrame:
    """One row per readable raster: order, bounds and size.

    Bounds come from names such as ``N31E121`` unless given.
    """
    named = R.srtm_bounds(base_name(F.col("dem_id")))
    given = [F.lit(float(b)) for b in bounds] if bounds else [F.lit(0.0)] * 4
    cols = [F.coalesce(named[f], g).alias(f) for f, g in zip(S.RECT_FIELDS, given)]
    order = F.row_number().over(W.orderBy("dem_id")) - 1  # one row per file
    return heads.where("reason IS NULL").select("dem_id", order.alias("tile_ord"), *cols, "width", "height")


def read_dem(
    spark: SparkSession, path: str, width: int = 0, height: int = 0, bounds: tuple | None = None, only: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(tiles, pixels)`` of an elevation file or folder.

    ``only`` (``path``) limits the files, for example to those that discovery
    takes for elevation.
    """
    files = list_dem_files(spark, path)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")
    pixels = decode(files, width, height)
    return tile_table(headers(files, width, height), bounds), pixels.select("dem_id", "px", "py", "elev")
