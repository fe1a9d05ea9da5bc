"""Feature readers, filters, tiling, roll-ups and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.catalogue.registry import query, r
from landloom.catalogue.scalars import RULES_SQL, TAG_COLS, VERTS, tagged, tile_sql
from landloom.catalogue.views import LAT0, LON0, d
from landloom.functions import geometry as G
from landloom.functions.projection import tile_id
from landloom.functions.tags import infer_category
from landloom.operators import filters as Fl
from landloom.operators import stats, tiling, validate
from landloom.operators.indexing import dense_index
from landloom.plans import tiled
from landloom.sinks import store
from landloom.sinks import tiles as sink
from landloom.sources import geojson, manifest

CATEGORY = "CASE WHEN k = 'building' THEN 'Building' WHEN k = 'landuse' THEN 'LandUse' WHEN v = 'water' THEN 'WaterBody' WHEN v = 'wood' THEN 'Natural' ELSE 'Other' END"


@query(
    "parse_geojson_features",
    f"WITH {VERTS} SELECT pid, {CATEGORY} AS category, 5 AS vertices, round(min(lon), 9) AS min_lon, round(max(lat), 9) AS max_lat, 3 AS properties "
    "FROM verts GROUP BY pid, k, v",
    ("box",),
)
def _(spark, sf):
    f = geojson.parse_features(V.feature_text(spark, sf)).withColumn("b", G.bbox(F.col("coords")))
    return f.select(
        F.col("feature_id").alias("pid"), "category", F.size("coords").alias("vertices"), r("b.min_lon", 9).alias("min_lon"),
        r("b.max_lat", 9).alias("max_lat"), F.size("props").alias("properties"),
    )


@query(
    "geojson_property_map",
    "SELECT pid, k AS key, v AS value FROM box UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'ok', 'true' FROM part",
    ("box",),
)
def _(spark, sf):
    f = geojson.parse_features(V.feature_text(spark, sf))
    return f.select(F.col("feature_id").alias("pid"), F.explode("props").alias("key", "value"))


@query(
    "explode_feature_collections",
    "SELECT CAST(floor(pid / 20) AS BIGINT) AS doc, pid % 20 AS pos, k AS key FROM box",
    ("box",),
)
def _(spark, sf):
    t = V.feature_text(spark, sf)
    docs = t.groupBy(F.floor(F.col("feature_id") / 20).alias("doc")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "feature"))), lambda x: x["feature"]).alias("f")
    )
    docs = docs.select("doc", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}")).alias("value"))
    rows = geojson.explode_collections(docs)
    parsed = geojson.parse_features(rows)
    first = F.filter(F.map_keys("props"), lambda k: ~k.isin("size", "ok"))[0]
    return parsed.select("doc", F.col("pos").cast("long").alias("pos"), first.alias("key"))


@query("features_by_geometry_type", "SELECT rid FROM road", ("road",))
def _(spark, sf):
    return Fl.by_geometry_type(V.all_features(spark, sf), "LineString").select((-F.col("feature_id") - 1).alias("rid"))


@query("features_by_property", "SELECT pid FROM box WHERE k = 'landuse' AND v = 'farmland'", ("box",))
def _(spark, sf):
    return Fl.by_property(V.boxes(spark, sf), "landuse", "farmland").select(F.col("feature_id").alias("pid"))


@query("features_by_category", "SELECT pid FROM box WHERE v = 'water'", ("box",))
def _(spark, sf):
    return Fl.categorize(V.boxes(spark, sf))["WaterBody"].select(F.col("feature_id").alias("pid"))


BOUNDS = (LON0 + 0.004, LAT0 + 0.003, LON0 + 0.9, LAT0 + 0.015)
IN_BOUNDS = f"lon BETWEEN {d(BOUNDS[0])} AND {d(BOUNDS[2])} AND lat BETWEEN {d(BOUNDS[1])} AND {d(BOUNDS[3])}"


@query("features_any_vertex_in_bounds", f"WITH {VERTS} SELECT DISTINCT pid FROM verts WHERE {IN_BOUNDS}", ("box",))
def _(spark, sf):
    return Fl.any_vertex_in_bounds(V.boxes(spark, sf), BOUNDS).select(F.col("feature_id").alias("pid"))


@query(
    "features_centroid_in_bounds",
    f"WITH {VERTS}, c AS (SELECT pid, sum(lon) / 5 AS lon, sum(lat) / 5 AS lat FROM verts GROUP BY pid) SELECT pid FROM c WHERE {IN_BOUNDS}",
    ("box",),
)
def _(spark, sf):
    return Fl.centroid_in_bounds(V.boxes(spark, sf), *BOUNDS).select(F.col("feature_id").alias("pid"))


@query("area_features_only", "SELECT pid FROM box", ("box",))
def _(spark, sf):
    return Fl.area_features(V.all_features(spark, sf)).select(F.col("feature_id").alias("pid"))


@query(
    "feature_ids_in_order",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS feature_id FROM orders",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return dense_index(o, [F.floor(F.col("o_custkey") / 64)], [F.col("o_custkey"), F.col("o_orderkey")], "feature_id").select("o_orderkey", "feature_id")


@query(
    "union_of_inputs",
    "SELECT 'area' AS source, count(*) AS features FROM part UNION ALL SELECT 'line', count(*) FROM orders",
)
def _(spark, sf):
    f = V.all_features(spark, sf)
    return f.groupBy(F.when(F.col("geom_type") == "Polygon", "area").otherwise("line").alias("source")).agg(F.count(F.lit(1)).alias("features"))


CORNERS_SQL = "corners AS (SELECT pid * 2 AS event_id, min(lon) AS lon, min(lat) AS lat FROM verts GROUP BY pid UNION ALL SELECT pid * 2 + 1, max(lon), max(lat) FROM verts GROUP BY pid)"
ASSIGNED = f"""{VERTS}, {CORNERS_SQL}, {tile_sql('corners', 'tc', 'tr')},
 rng AS (SELECT CAST(floor(event_id / 2) AS BIGINT) AS pid, min(tc) AS c0, min(tr) AS r0, max(tc) AS c1, max(tr) AS r1 FROM u3 GROUP BY 1),
 cols AS (SELECT *, unnest(range(c0, c1 + 1)) AS tile_col FROM rng),
 assigned AS (SELECT pid, c0 <> c1 OR r0 <> r1 AS clipped, CAST(tile_col AS INT) AS tile_col, CAST(unnest(range(r0, r1 + 1)) AS INT) AS tile_row FROM cols)"""


def assigned(spark, sf):
    return tiling.assign_tiles(tiling.with_bbox(V.boxes(spark, sf)), V.GRID)


@query("features_to_covered_tiles", f"WITH {ASSIGNED} SELECT pid, tile_col, tile_row, clipped FROM assigned", ("box",))
def _(spark, sf):
    return assigned(spark, sf).select(F.col("feature_id").alias("pid"), "tile_col", "tile_row", "clipped")


COUNTS = "counts AS (SELECT tile_col, tile_row, count(*) AS feature_count FROM assigned GROUP BY ALL)"
KX, KY = f"(cos(radians({d(LAT0)})) * pi() * {d(6378137)} / 180)", f"(pi() * {d(6378137)} / 180)"
TILES = f"""{COUNTS}, tiles AS (SELECT *, {d(LON0)} + tile_col * {d(1000)} / {KX} AS min_lon, {d(LAT0)} + tile_row * {d(1000)} / {KY} AS min_lat,
 {d(LON0)} + (tile_col + 1) * {d(1000)} / {KX} AS max_lon, {d(LAT0)} + (tile_row + 1) * {d(1000)} / {KY} AS max_lat FROM counts)"""


@query("tile_feature_counts", f"WITH {ASSIGNED}, {COUNTS} SELECT * FROM counts", ("box",))
def _(spark, sf):
    return tiling.tile_counts(assigned(spark, sf))


@query("tiles_sorted", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, 'tile_' || tile_col || '_' || tile_row AS tile_id FROM counts ORDER BY 1, 2", ("box",))
def _(spark, sf):
    t = tiling.sorted_tiles(tiling.tile_counts(assigned(spark, sf)))
    return t.select("tile_col", "tile_row", tile_id(F.col("tile_col"), F.col("tile_row")).alias("tile_id"))


@query(
    "manifest_rollup",
    f"""WITH {ASSIGNED}, {TILES} SELECT count(*) AS num_tiles, max(tile_col) - min(tile_col) + 1 AS num_cols, max(tile_row) - min(tile_row) + 1 AS num_rows,
    round(min(min_lon), 9) AS min_lon, round(min(min_lat), 9) AS min_lat, round(max(max_lon), 9) AS max_lon, round(max(max_lat), 9) AS max_lat,
    CAST(sum(feature_count) AS BIGINT) AS total_features FROM tiles""",
    ("box",),
)
def _(spark, sf):
    m = tiling.manifest_rollup(tiling.tile_table(assigned(spark, sf), V.GRID))
    return m.select("num_tiles", "num_cols", "num_rows", *[r(c, 9).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], "total_features")


@query(
    "manifest_round_trip",
    f"""WITH {ASSIGNED}, {TILES} SELECT tile_col, tile_row, feature_count, round(min_lon, 9) AS min_lon, round(max_lat, 9) AS max_lat, 51 AS zone, true AS north,
    'features/tile_col=' || tile_col || '/tile_row=' || tile_row AS geojson FROM tiles""",
    ("box",),
)
def _(spark, sf):
    doc = sink.manifest_document(tiling.tile_table(assigned(spark, sf), V.GRID), V.GRID)
    head, tiles = manifest.parse_manifest(doc)
    return tiles.withColumn("_k", F.lit(1)).join(F.broadcast(head.select("zone", "north", F.lit(1).alias("_k"))), "_k").select(  # one row
        "tile_col", "tile_row", "feature_count", r("min_lon", 9).alias("min_lon"), r("max_lat", 9).alias("max_lat"), "zone", "north", "geojson"
    )


@query("busiest_tile", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, feature_count FROM counts ORDER BY feature_count DESC, tile_col, tile_row LIMIT 1", ("box",))
def _(spark, sf):
    t = tiling.tile_counts(assigned(spark, sf)).withColumn("tile_ord", F.struct("tile_col", "tile_row"))
    return tiling.busiest_tile(t).drop("tile_ord")


@query(
    "first_copy_per_feature",
    f"""WITH {ASSIGNED}, o AS (SELECT pid, tile_col, tile_row, row_number() OVER (PARTITION BY pid ORDER BY tile_col, tile_row) AS n FROM assigned)
    SELECT pid, tile_col, tile_row FROM o WHERE n = 1""",
    ("box",),
)
def _(spark, sf):
    rows = assigned(spark, sf).select("feature_id", "tile_col", "tile_row")
    return tiling.first_copies(rows, "feature_id", ("tile_col", "tile_row")).withColumnRenamed("feature_id", "pid")


@query(
    "tiles_for_query_bounds",
    f"""WITH {ASSIGNED}, {TILES}, q AS (SELECT pid, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS e FROM verts GROUP BY pid)
    SELECT pid, tile_col, tile_row FROM q JOIN tiles ON NOT (max_lon < a OR min_lon > c OR max_lat < b OR min_lat > e)""",
    ("box",),
)
def _(spark, sf):
    q = tiling.with_bbox(V.boxes(spark, sf)).select(
        F.col("feature_id").alias("pid"), *[F.col(c).alias(f"q_{c}") for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    )
    tiles = tiling.tile_table(assigned(spark, sf), V.GRID)
    return tiling.tiles_for_bounds(q, tiles, V.GRID).select("pid", "tile_col", "tile_row")


@query("tiles_in_bounds", f"WITH {ASSIGNED}, {TILES} SELECT tile_col, tile_row FROM tiles WHERE NOT (max_lon < {d(BOUNDS[0])} OR min_lon > {d(BOUNDS[2])} OR max_lat < {d(BOUNDS[1])} OR min_lat > {d(BOUNDS[3])})", ("box",))
def _(spark, sf):
    return Fl.tiles_in_bounds(tiling.tile_table(assigned(spark, sf), V.GRID), BOUNDS).select("tile_col", "tile_row")


@query("find_tile", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, feature_count FROM counts WHERE tile_col = 1 AND tile_row = 1", ("box",))
def _(spark, sf):
    t = tiling.tile_counts(assigned(spark, sf)).withColumn("tile_ord", F.lit(0))
    return Fl.find_tile(t, 1, 1).drop("tile_ord")


@query("tiles_in_world_box", f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row FROM counts WHERE tile_col BETWEEN 3 AND 60 AND tile_row BETWEEN 0 AND 1", ("box",))
def _(spark, sf):
    t = tiling.tile_counts(assigned(spark, sf))
    return Fl.tiles_in_world_box(t, 300_000.0, 500.0, 6_050_000.0, 199_999.0, 1000.0).select("tile_col", "tile_row")


@query(
    "duplicate_tile_rows",
    f"WITH {ASSIGNED} SELECT tile_col, tile_row, count(*) AS copies FROM assigned GROUP BY ALL HAVING count(*) > 1",
    ("box",),
)
def _(spark, sf):
    return tiling.duplicate_tiles(assigned(spark, sf))


# Every third tile declares one feature too many, every fifth lost its file.
@query(
    "validation_issues",
    f"""WITH {ASSIGNED}, {COUNTS}, t AS (SELECT *, feature_count + CASE WHEN feature_count % 3 = 0 THEN 1 ELSE 0 END AS declared, feature_count % 5 = 0 AS lost FROM counts)
    SELECT tile_col, tile_row, 'geojson_missing' AS rule, 'features/tile_col=' || tile_col || '/tile_row=' || tile_row AS detail FROM t WHERE lost
    UNION ALL SELECT tile_col, tile_row, 'count_mismatch', feature_count || '/' || declared FROM t WHERE NOT lost AND declared <> feature_count""",
    ("box",),
)
def _(spark, sf):
    tiles = tiling.tile_table(assigned(spark, sf), V.GRID)
    actual = tiles.where("feature_count % 5 <> 0").select("tile_col", "tile_row", F.col("feature_count").alias("actual_count"))
    declared = tiles.withColumn("feature_count", F.when(F.col("feature_count") % 3 == 0, F.col("feature_count") + 1).otherwise(F.col("feature_count")))
    return validate.tile_issues(declared, actual)


@query(
    "validation_summary",
    f"""WITH {ASSIGNED}, {COUNTS} SELECT count(*) AS tiles, CAST(sum(feature_count) AS BIGINT) AS features,
    count(*) FILTER (WHERE feature_count % 5 = 0) AS issues FROM counts""",
    ("box",),
)
def _(spark, sf):
    tiles = tiling.tile_table(assigned(spark, sf), V.GRID)
    actual = tiles.where("feature_count % 5 <> 0").select("tile_col", "tile_row", F.col("feature_count").alias("actual_count"))
    return validate.summary(tiles, validate.tile_issues(tiles, actual))


@query(
    "tile_query_features",
    f"""WITH {ASSIGNED}, {TILES}, c AS (SELECT pid, sum(lon) / 5 AS lon, sum(lat) / 5 AS lat FROM verts GROUP BY pid)
    SELECT c.pid, tile_col, tile_row FROM c JOIN tiles ON lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat
    WHERE EXISTS (SELECT 1 FROM assigned a WHERE a.pid = c.pid AND a.tile_col BETWEEN tiles.tile_col - 1 AND tiles.tile_col + 1
      AND a.tile_row BETWEEN tiles.tile_row - 1 AND tiles.tile_row + 1)""",
    ("box",),
)
def _(spark, sf):
    copies = assigned(spark, sf).select("feature_id", "tile_col", "tile_row", "coords")
    tiles = tiling.tile_table(copies, V.GRID).withColumn("tile_ord", F.struct("tile_col", "tile_row"))
    return tiled.query_tile_features(copies, tiles, V.GRID).select(F.col("feature_id").alias("pid"), "tile_col", "tile_row")


STATS_TAGS = "b AS (SELECT pid, " + CATEGORY + " AS category FROM box)"


@query(
    "vector_stats",
    f"WITH {STATS_TAGS} SELECT (SELECT count(*) FROM road) AS roads, CAST(0 AS BIGINT) AS rivers, CAST(0 AS BIGINT) AS coastlines, "
    "count(*) FILTER (WHERE category = 'WaterBody') AS water_bodies, (SELECT count(*) FROM road) + count(*) AS total FROM b",
    ("box", "road"),
)
def _(spark, sf):
    return stats.vector_stats(V.all_features(spark, sf))


@query(
    "feature_bounds_padded",
    f"""WITH {VERTS}, a AS (SELECT lon, lat FROM verts UNION ALL SELECT lon0, lat0 FROM road UNION ALL SELECT lon1, lat1 FROM road),
    m AS (SELECT min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS e FROM a)
    SELECT round(a - (c - a) * {d(0.1)}, 9) AS min_lon, round(b - (e - b) * {d(0.1)}, 9) AS min_lat,
    round(c + (c - a) * {d(0.1)}, 9) AS max_lon, round(e + (e - b) * {d(0.1)}, 9) AS max_lat FROM m""",
    ("box", "road"),
)
def _(spark, sf):
    b = stats.feature_bounds(V.all_features(spark, sf))
    return b.select(*[r(c, 9).alias(c) for c in b.columns])


@query(
    "category_counts_by_tags",
    f"WITH t AS (SELECT p_partkey, {TAG_COLS} FROM part) SELECT {RULES_SQL} AS category, count(*) AS n FROM t GROUP BY 1",
)
def _(spark, sf):
    return tagged(spark, sf).groupBy(infer_category(F.col("props")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tile_landuse_store_catalog",
    f"WITH {ASSIGNED}, {COUNTS} SELECT tile_col, tile_row, feature_count AS polygon_count, 'tile_' || tile_col || '_' || tile_row AS tile_id FROM counts",
    ("box",),
)
def _(spark, sf):
    return stats.catalog(assigned(spark, sf))


@query(
    "catalog_tile_counts",
    f"WITH {ASSIGNED}, {COUNTS} SELECT count(*) AS all_tiles, count(*) FILTER (WHERE feature_count > 5) AS loaded_tiles FROM counts",
    ("box",),
)
def _(spark, sf):
    t = tiling.tile_counts(assigned(spark, sf))
    return store.catalog_counts(t, t.where("feature_count > 5"))
