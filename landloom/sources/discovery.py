"""Discovery of input files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.sources.dem import file_extension


def discover_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """``path, kind`` of inputs; kind is pbf, geojson, dem or landcover.

    Vector files count in the folder itself, rasters at any depth. Rasters
    named as WorldCover are land cover and never elevation. Only listings are
    read: the content column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").removeprefix("file:")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parent = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"^file:/*", "/")
    top = parent == F.lit(root)
    ext = file_extension(F.col("path"))
    cover = name.rlike(r"^(ESA_WorldCover|worldcover).*\.tif$")
    any_cover = F.lower(name).contains("worldcover")
    kind = (
        F.when(top & name.endswith(".osm.pbf"), "pbf")
        .when(top & ext.isin("geojson", "json"), "geojson")
        .when(cover, "landcover")
        .when(ext.isin("tif", "hgt") & ~any_cover, "dem")
    )
    return files.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def stored_folders(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every folder under ``folder`` that holds files, relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    root = folder.rstrip("/").removeprefix("file:").lstrip("/")
    parent = F.regexp_replace(F.regexp_extract("path", r"^(.*)/[^/]+$", 1), r"^file:/*", "")
    return files.select(F.substring(parent, len(root) + 2, 1 << 20).alias("path")).distinct()
