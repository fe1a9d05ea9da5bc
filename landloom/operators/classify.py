"""Rule classification of polygons and per-type generation parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import tags as K
from landloom.schema import ClassifyRules

SETBACK_M = {"main_commercial": 10.0, "main": 8.0, "plain": 5.0}
DEFAULTS = {"building_density": 0.0, "vegetation_density": 0.0, "min_floors": 1, "max_floors": 3, "building_setback": 5.0}


def land_use_by_rules(rules: ClassifyRules):
    """The rule chain over ``area_sqm, avg_slope, avg_elevation, adjacent_main_road``."""
    slope, elev, area = F.col("avg_slope"), F.col("avg_elevation"), F.col("area_sqm")
    built = F.when(F.col("adjacent_main_road"), "Commercial").otherwise("Residential")
    return (
        F.when(slope > rules.hill_min_slope, "Forest")
        .when(elev > rules.high_elevation_min, "Forest")
        .when((area < rules.small_block_max_area) | (area < rules.large_block_min_area), built)
        .when(slope <= rules.flat_max_slope, F.when(elev < rules.low_elevation_max, "Farmland").otherwise("Industrial"))
        .otherwise("OpenSpace")
    )


def classify(polygons: DataFrame, rules: ClassifyRules | None, keep_water: bool = False) -> DataFrame:
    """Set ``land_use`` by rule; without rules the polygons are unchanged.

    The rules look at no earlier type, so a polygon found to be water is
    classified again unless ``keep_water``.
    """
    if rules is None:
        return polygons
    decided = land_use_by_rules(rules)
    if keep_water:
        decided = F.when(F.col("land_use") == "Water", "Water").otherwise(decided)
    return polygons.withColumn("land_use", decided)


def classify_or_unknown(polygons: DataFrame, rules: ClassifyRules | None) -> DataFrame:
    """Single-polygon form: without rules the type becomes Unknown."""
    return polygons.withColumn("land_use", F.lit("Unknown")) if rules is None else classify(polygons, rules)


def assign_parameters(polygons: DataFrame, rules: ClassifyRules | None) -> DataFrame:
    """Densities, floors and setback by type; an unlisted type keeps its values."""
    if rules is None:
        return polygons
    kind = F.col("land_use")

    def update(name: str, table: dict):
        return F.coalesce(K.lookup(kind, table), F.col(name)) if table else F.col(name)

    lo = {k: v[0] for k, v in rules.floor_range.items()}
    hi = {k: v[1] for k, v in rules.floor_range.items()}
    main = F.col("adjacent_main_road")
    setback = (
        F.when(main & (kind == "Commercial"), SETBACK_M["main_commercial"])
        .when(main, SETBACK_M["main"])
        .otherwise(SETBACK_M["plain"])
    )
    return polygons.withColumns(
        {
            "building_density": update("building_density", rules.building_density),
            "vegetation_density": update("vegetation_density", rules.vegetation_density),
            "min_floors": update("min_floors", lo),
            "max_floors": update("max_floors", hi),
            "building_setback": setback,
        }
    )


def with_defaults(polygons: DataFrame) -> DataFrame:
    """Add the parameter columns with their default values where missing."""
    missing = {k: F.lit(v) for k, v in DEFAULTS.items() if k not in polygons.columns}
    return polygons.withColumns(missing) if missing else polygons
