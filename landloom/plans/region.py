"""One call per input mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landloom.operators.stats import type_report
from landloom.plans.derive import derive
from landloom.schema import ClassifyRules
from landloom.sinks.store import read_store
from landloom.sources.provider import ArcGIS, LocalFiles, Provider, TiledFiles

MODES = ("local", "arcgis", "store", "tiled")


def provider_for(spark: SparkSession, mode: str, path: str, **options) -> Provider:
    made = {"local": LocalFiles, "arcgis": ArcGIS, "tiled": TiledFiles}[mode](spark, path, **options)
    if not made.available():
        raise FileNotFoundError(f"{made.name} provider is not available: {path!r}")
    return made


def generate_region(
    spark: SparkSession,
    mode: str,
    path: str,
    origin_lon: float = 0.0,
    origin_lat: float = 0.0,
    bounds=None,
    rules: ClassifyRules | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """``(polygons, statistics)`` of a region.

    ``store`` reads saved polygons; the other modes derive them.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "store":
        polygons = read_store(spark, path)
        return polygons, type_report(polygons)
    source = provider_for(spark, mode, path, **options)
    features = source.features(bounds)
    polygons = derive(spark, features, origin_lon, origin_lat, rules, source.dem(), bounds)
    return polygons, type_report(polygons)


def derive_from_files(
    spark: SparkSession, dem_path: str, geojson_path: str, origin_lon: float, origin_lat: float, rules: ClassifyRules | None = None, **options
) -> DataFrame:
    """Elevation and features by path; the bounds come from the features."""
    source = LocalFiles(spark, geojson_path, dem_path, **options)
    return derive(spark, source.features(), origin_lon, origin_lat, rules, source.dem())
