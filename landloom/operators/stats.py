"""Roll-ups over features, polygons and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions.projection import tile_id


def total_area(polygons: DataFrame) -> DataFrame:
    return polygons.agg(F.coalesce(F.sum("area_sqm"), F.lit(0.0)).alias("total_area_sqm"))


def count_by_type(polygons: DataFrame) -> DataFrame:
    return polygons.groupBy("land_use").agg(F.count(F.lit(1)).alias("polygon_count"))


def type_report(polygons: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, area and share of area per land-use type.

    With ``keys`` the shares are within each key (for example per tile). The
    totals are computed from the per-type rows - at most ten per key - so the
    polygons are shuffled once.
    """
    per_type = polygons.groupBy(*keys, "land_use").agg(
        F.count(F.lit(1)).alias("polygon_count"), F.sum("area_sqm").alias("area_sqm")
    )
    total = F.sum("area_sqm").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return per_type.withColumn("pct", F.when(total > 0, F.col("area_sqm") / total * 100.0).otherwise(F.lit(0.0)))


def vector_stats(features: DataFrame) -> DataFrame:
    """Counts of roads, rivers, coastlines, water bodies, and of all features."""

    def n(category: str, name: str):
        return F.count_if(F.col("category") == category).alias(name)

    return features.agg(
        n("Road", "roads"),
        n("River", "rivers"),
        n("Coastline", "coastlines"),
        n("WaterBody", "water_bodies"),
        F.count(F.lit(1)).alias("total"),
    )


def feature_bounds(features: DataFrame, pad: float = 0.1) -> DataFrame:
    """Bounds over every vertex, each side padded by a share of the span.

    Each row reduces to its own extent first, so nothing is exploded.
    """
    lons = F.transform("coords", lambda p: p["lon"])
    lats = F.transform("coords", lambda p: p["lat"])
    agg = features.agg(
        F.min(F.array_min(lons)).alias("lo_lon"),
        F.min(F.array_min(lats)).alias("lo_lat"),
        F.max(F.array_max(lons)).alias("hi_lon"),
        F.max(F.array_max(lats)).alias("hi_lat"),
    ).where("lo_lon IS NOT NULL")
    pad_lon = (F.col("hi_lon") - F.col("lo_lon")) * pad
    pad_lat = (F.col("hi_lat") - F.col("lo_lat")) * pad
    return agg.select(
        (F.col("lo_lon") - pad_lon).alias("min_lon"),
        (F.col("lo_lat") - pad_lat).alias("min_lat"),
        (F.col("hi_lon") + pad_lon).alias("max_lon"),
        (F.col("hi_lat") + pad_lat).alias("max_lat"),
    )


def batch_outcome(tiles: DataFrame, polygons: DataFrame) -> DataFrame:
    """Outcome of a catalog build: one row per status with tiles and polygons.

    A tile with polygons is a success, one that declares no features is
    skipped, any other failed.
    """
    built = polygons.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("polygons"))
    status = (
        F.when(F.col("polygons").isNotNull(), "success")
        .when(F.coalesce(F.col("feature_count"), F.lit(0)) == 0, "skipped")
        .otherwise("failed")
    )
    return (
        tiles.join(built, ["tile_col", "tile_row"], "left")
        .withColumn("status", status)
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("tiles"),
            F.coalesce(F.sum("polygons"), F.lit(0)).cast("long").alias("polygons"),
        )
    )


def catalog(polygons: DataFrame) -> DataFrame:
    """Stored tiles and their polygon counts."""
    return (
        polygons.groupBy("tile_col", "tile_row")
        .agg(F.count(F.lit(1)).alias("polygon_count"))
        .withColumn("tile_id", tile_id(F.col("tile_col"), F.col("tile_row")))
    )


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes and of live edges."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("k", F.lit(1))
    e = edges.agg(F.count(F.lit(1)).alias("edges")).withColumn("k", F.lit(1))
    return n.join(e, "k").select("nodes", "edges")
