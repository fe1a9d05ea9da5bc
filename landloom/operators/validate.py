"""Checks of a tiling output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.operators.tiling import duplicate_tiles

REQUIRED = ("projection", "origin_lon", "origin_lat", "tile_size_m", "tiles")
KEYS = ["tile_col", "tile_row"]


def _issues(df: DataFrame, rule: str, detail) -> DataFrame:
    return df.select(
        F.col("tile_col").cast("int").alias("tile_col"),
        F.col("tile_row").cast("int").alias("tile_row"),
        F.lit(rule).alias("rule"),
        detail.alias("detail"),
    )


def manifest_issues(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Issues of manifest documents: unreadable JSON, missing fields, no tiles."""
    fields = F.json_object_keys(F.col(text_col))
    none = docs.withColumns({"tile_col": F.lit(None), "tile_row": F.lit(None), "_keys": fields})
    bad = _issues(none.where(F.col("_keys").isNull()), "manifest_json", F.lit("manifest is not a JSON object"))
    readable = none.where(F.col("_keys").isNotNull())
    missing = readable.withColumn("_m", F.explode(F.array_except(F.array(*[F.lit(f) for f in REQUIRED]), "_keys")))
    count = F.coalesce(F.json_array_length(F.get_json_object(text_col, "$.tiles")), F.lit(0))
    return bad.unionByName(_issues(missing, "missing_field", F.col("_m"))).unionByName(
        _issues(readable.where(count == 0), "no_tiles", F.lit("manifest lists no tiles"))
    )


def tile_issues(tiles: DataFrame, actual: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Issues ``tile_col, tile_row, rule, detail`` of a tile list.

    ``actual`` has the rows found per tile (``tile_col, tile_row,
    actual_count``); ``files`` lists the stored relative paths (``path``) for
    the elevation and land-cover checks.
    """
    dup = _issues(duplicate_tiles(tiles), "duplicate_tile", F.col("copies").cast("string"))
    listed = tiles.where(F.col("geojson") != "").join(actual, KEYS, "left")
    lost = _issues(listed.where("actual_count IS NULL"), "geojson_missing", F.col("geojson"))
    differs = _issues(
        listed.where("actual_count <> feature_count"),
        "count_mismatch",
        F.concat_ws("/", F.col("actual_count").cast("string"), F.col("feature_count").cast("string")),
    )
    lon_order = _issues(tiles.where("min_lon >= max_lon"), "lon_order", F.lit("min_lon >= max_lon"))
    lat_order = _issues(tiles.where("min_lat >= max_lat"), "lat_order", F.lit("min_lat >= max_lat"))
    lon_range = _issues(
        tiles.where("NOT (min_lon BETWEEN -180 AND 180 AND max_lon BETWEEN -180 AND 180)"), "lon_range", F.lit("longitude")
    )
    lat_range = _issues(
        tiles.where("NOT (min_lat BETWEEN -90 AND 90 AND max_lat BETWEEN -90 AND 90)"), "lat_range", F.lit("latitude")
    )
    found = dup
    for part in (lost, differs, lon_order, lat_order, lon_range, lat_range):
        found = found.unionByName(part)
    if files is not None:
        known = files.select(F.col("path").alias("_path")).distinct()
        for kind in ("dem", "landcover"):
            named = tiles.where(F.col(kind) != "")
            gone = named.join(known, named[kind] == known["_path"], "left_anti")
            found = found.unionByName(_issues(gone, f"{kind}_missing", F.col(kind)))
    return found


def summary(tiles: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: tiles, declared features, issues."""
    t = tiles.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum("feature_count"), F.lit(0)).cast("long").alias("features"))
    i = issues.agg(F.count(F.lit(1)).alias("issues"))
    return t.withColumn("_k", F.lit(1)).join(i.withColumn("_k", F.lit(1)), "_k").drop("_k")
