"""Composed jobs, and queries over files: views are written to the run's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.catalogue.features import ASSIGNED, BOUNDS, CORNERS_SQL, COUNTS, IN_BOUNDS, TILES
from landloom.catalogue.landuse import MAIN, POLY, RULES
from landloom.catalogue.registry import query, r
from landloom.catalogue.scalars import VERTS
from landloom.operators import landcover as L
from landloom.operators import tiling
from landloom.plans import tiled
from landloom.session import ensure_checkpoint_dir
from landloom.sources import geojson
from landloom.sources.provider import LocalFiles, TiledFiles


# All features (road ids are -rid - 1), their tiles, and every tile's own query.
EVERY = "every AS (SELECT pid, lon, lat FROM verts UNION ALL SELECT -rid - 1, lon0, lat0 FROM road UNION ALL SELECT -rid - 1, lon1, lat1 FROM road)"
PLACED = ASSIGNED.removeprefix(VERTS + ", ").replace(CORNERS_SQL, f"{EVERY}, {CORNERS_SQL.replace('FROM verts', 'FROM every')}")
NEAR_IN_TILE = MAIN.replace("SELECT lon0 AS lon, lat0 AS lat FROM road", "SELECT tile_col, tile_row, lon0 AS lon, lat0 AS lat FROM road JOIN tf ON tf.pid = -rid - 1").replace(
    "SELECT lon1, lat1 FROM road", "SELECT tile_col, tile_row, lon1, lat1 FROM road JOIN tf ON tf.pid = -rid - 1"
)
NEAR_IN_TILE = NEAR_IN_TILE.replace("AS y FROM rv", "AS y, tile_col, tile_row FROM rv").replace("SELECT DISTINCT pid FROM poly JOIN rw ON", "SELECT DISTINCT pid, tile_col, tile_row FROM tpoly JOIN rw USING (tile_col, tile_row) WHERE")


def placed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All features with their tiles, and the tile table."""
    features = tiling.assign_tiles(tiling.with_bbox(V.all_features(spark, sf)), V.GRID)
    t = tiling.tile_table(features, V.GRID).withColumn("tile_ord", F.struct("tile_col", "tile_row"))
    return features.drop("min_lon", "min_lat", "max_lon", "max_lat"), t


ALL_TILES = f"""WITH {POLY}, {PLACED}, {TILES}, c AS (SELECT pid, sum(lon) / count(*) AS lon, sum(lat) / count(*) AS lat FROM every GROUP BY pid),
    tf AS (SELECT c.pid, tile_col, tile_row FROM c JOIN tiles ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat
      WHERE EXISTS (SELECT 1 FROM assigned a WHERE a.pid = c.pid AND a.tile_col BETWEEN tiles.tile_col - 1 AND tiles.tile_col + 1 AND a.tile_row BETWEEN tiles.tile_row - 1 AND tiles.tile_row + 1)),
    tpoly AS (SELECT poly.*, tile_col, tile_row FROM poly JOIN tf USING (pid)), {NEAR_IN_TILE},
    ruled AS (SELECT t.*, CASE WHEN area_sqm < 20000 THEN CASE WHEN near.pid IS NOT NULL THEN 'Commercial' ELSE 'Residential' END ELSE 'Farmland' END AS land_use
      FROM (SELECT pid, area_sqm, tile_col, tile_row FROM tpoly) t LEFT JOIN near USING (pid, tile_col, tile_row))
    SELECT tile_col, tile_row, land_use, count(*) AS polygons, round(sum(area_sqm), 2) AS area_sqm FROM ruled GROUP BY ALL"""


@query("all_tiles_build", ALL_TILES, ("box", "road"))
def _(spark, sf):
    features, t = placed(spark, sf)
    p = tiled.build_all_tiles(features, t, V.GRID, RULES)
    return p.groupBy("tile_col", "tile_row", "land_use").agg(F.count(F.lit(1)).alias("polygons"), r(F.sum("area_sqm"), 2).alias("area_sqm"))


@query(
    "test_tile_build",
    f"""SELECT q.* FROM ({ALL_TILES}) q JOIN (WITH {POLY}, {PLACED}, {TILES} SELECT tile_col, tile_row FROM tiles ORDER BY feature_count DESC, tile_col, tile_row LIMIT 1) b
    ON b.tile_col = q.tile_col AND b.tile_row = q.tile_row""",
    ("box", "road"),
)
def _(spark, sf):
    features, t = placed(spark, sf)
    p = tiled.build_test_tile(features, t, V.GRID, RULES)
    return p.groupBy("tile_col", "tile_row", "land_use").agg(F.count(F.lit(1)).alias("polygons"), r(F.sum("area_sqm"), 2).alias("area_sqm"))


def folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def feature_files(spark: SparkSession, sf: str) -> str:
    """The boxes as newline-delimited GeoJSON files; the key is a property."""
    path = folder(spark)
    lines = V.feature_text(spark, sf).select(
        F.lit("Feature").alias("type"),
        F.map_concat(
            F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>"),
            F.create_map(F.lit("pid"), F.col("feature_id").cast("string"), F.lit("note"), F.lit("[old] {name}")),
        ).alias("properties"),
        F.from_json(F.get_json_object("feature", "$.geometry"), "type string, coordinates array<array<array<double>>>").alias("geometry"),
    )
    lines.write.json(path)
    return path


def pid(props: str = "props"):
    return F.element_at(props, "pid").cast("long").alias("pid")


def tiled_output(spark: SparkSession, sf: str, cover: bool = False) -> tuple[str, DataFrame]:
    out = folder(spark)
    issues = tiled.preprocess(spark, feature_files(spark, sf), out, V.GRID, skip_dem=True, placeholder_landcover=cover, lines=True)
    return out, issues


@query("geojson_bracketed_strings", "SELECT pid, '[old] {name}' AS note, CAST(NULL AS VARCHAR) AS deep FROM box", ("box",))
def _(spark, sf):
    text = F.regexp_replace("feature", '"size"', '"note":"[old] {name}","size"')
    f = geojson.parse_features(V.feature_text(spark, sf).withColumn("feature", text))
    return f.select(F.col("feature_id").alias("pid"), F.element_at("props", "note").alias("note"), F.element_at("props", "deep").alias("deep"))


@query("local_provider_features", f"WITH {VERTS} SELECT DISTINCT pid, '[old] {{name}}' AS note FROM verts WHERE {IN_BOUNDS}", ("box",))
def _(spark, sf):
    found = LocalFiles(spark, feature_files(spark, sf), lines=True).features(BOUNDS)
    return found.select(pid(), F.element_at("props", "note").alias("note"))


@query("tiled_provider_features", "SELECT pid, CAST(1 AS BIGINT) AS copies FROM box", ("box",))
def _(spark, sf):
    out, _ = tiled_output(spark, sf)
    found = TiledFiles(spark, f"{out}/manifest").features()
    return found.select(pid()).groupBy("pid").agg(F.count(F.lit(1)).alias("copies"))


@query("stored_tile_counts", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, feature_count, 'none' AS rule FROM counts", ("box",))
def _(spark, sf):
    out, issues = tiled_output(spark, sf)
    tiles = TiledFiles(spark, f"{out}/manifest").tiles()
    found = tiles.select("tile_col", "tile_row", "feature_count").join(issues.select("tile_col", "tile_row", "rule"), ["tile_col", "tile_row"], "left")
    return found.withColumn("rule", F.coalesce("rule", F.lit("none")))


@query("tiled_provider_landcover", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, CAST(100 AS BIGINT) AS pixels, CAST(3000 AS BIGINT) AS code_sum FROM counts", ("box",))
def _(spark, sf):
    out, _ = tiled_output(spark, sf, cover=True)
    _, pixels = TiledFiles(spark, f"{out}/manifest").landcover()
    return pixels.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("pixels"), F.sum("code").alias("code_sum"))


@query(
    "tiled_provider_landcover_in_bounds",
    f"""WITH {ASSIGNED}, {TILES} SELECT tile_col, tile_row, CAST(100 AS BIGINT) AS pixels FROM tiles
    WHERE NOT (max_lon < {BOUNDS[0]} OR min_lon > {BOUNDS[2]} OR max_lat < {BOUNDS[1]} OR min_lat > {BOUNDS[3]})""",
    ("box",),
)
def _(spark, sf):
    out, _ = tiled_output(spark, sf, cover=True)
    _, pixels = TiledFiles(spark, f"{out}/manifest").landcover(BOUNDS)
    return pixels.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("pixels"))


# Polygons on the seam of two sheets: every box is held by its own sheet and the next.
@query(
    "landcover_votes_in_two_tiles",
    """WITH own AS (SELECT bc, br, min(code) AS code FROM lc WHERE x = 0 AND y = 0 GROUP BY ALL)
    SELECT bc AS tile_col, br AS tile_row, CASE WHEN code IN (10, 20, 95) THEN 'Forest' WHEN code IN (30, 60, 70, 100) THEN 'OpenSpace' WHEN code = 40 THEN 'Farmland'
      WHEN code = 50 THEN 'Residential' ELSE 'Water' END AS land_use FROM own""",
    ("lc",),
)
def _(spark, sf):
    grids = V.landcover_grids(spark, sf)
    corner = F.array(F.struct((F.col("min_lon") + 1e-6).alias("lon"), (F.col("max_lat") - 1e-6).alias("lat")))
    # One id, null, in every tile: rows are told apart by their tile and window.
    polygons = grids.select(F.lit(None).cast("long").alias("polygon_id"), "tile_col", "tile_row", corner.alias("geo_vertices"), F.lit("Unknown").alias("land_use"))
    return L.fuse_landcover(polygons, V.landcover_pixels(spark, sf), grids).select("tile_col", "tile_row", "land_use")


@query("stored_features_first_copies", "SELECT pid FROM box", ("box",))
def _(spark, sf):
    out, _ = tiled_output(spark, sf)
    return tiling.first_copies(TiledFiles(spark, f"{out}/manifest").copies(), "feature_id").select(pid())
