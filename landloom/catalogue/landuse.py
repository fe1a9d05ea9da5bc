"""Polygons, classification, land cover, statistics, sampling, store."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.catalogue.registry import query, r
from landloom.catalogue.scalars import KLAT, KLON, VERTS, WORLD, tile_sql
from landloom.catalogue.views import LAT0, LON0, d
from landloom.functions import geometry as G
from landloom.functions.tags import category_to_type
from landloom.operators import classify as C
from landloom.operators import filters as Fl
from landloom.operators import landcover as L
from landloom.operators import sampling, spatial, stats, tiling
from landloom.plans import derive as D
from landloom.schema import LAND_USE_TYPES, ClassifyRules
from landloom.sinks import store, tiles
from landloom.sources import landcover as lc_source

RULES = ClassifyRules(
    building_density={"Residential": 0.5, "Commercial": 0.8, "Farmland": 0.05},
    vegetation_density={"Residential": 0.3, "Farmland": 0.9},
    floor_range={"Residential": (2, 6), "Commercial": (3, 20)},
)

# Area, centre and first type of every box, in world centimetres.
POLY = f"""{VERTS}, {WORLD},
 area AS (SELECT a.pid, abs(sum(a.x * b.y - b.x * a.y) / 2) / 10000 AS area_sqm FROM world a JOIN world b ON a.pid = b.pid AND b.i = (a.i + 1) % 5 GROUP BY a.pid),
 ctr AS (SELECT pid, sum(x) / 5 AS cx, sum(y) / 5 AS cy FROM world GROUP BY pid),
 gctr AS (SELECT pid, sum(lon) / 5 AS glon, sum(lat) / 5 AS glat FROM verts GROUP BY pid),
 poly0 AS (SELECT box.pid, area_sqm, cx, cy, glon, glat, CASE WHEN k = 'building' THEN 'Residential' WHEN v = 'water' THEN 'Water'
   WHEN v = 'wood' THEN 'Forest' WHEN v = 'farmland' THEN 'Farmland' WHEN v = 'residential' THEN 'Residential' ELSE 'Unknown' END AS land_use, v
   FROM box JOIN area USING (pid) JOIN ctr USING (pid) JOIN gctr USING (pid)),
 poly AS (SELECT * FROM poly0 WHERE area_sqm >= 800)"""
MAIN = f"""rv AS (SELECT lon0 AS lon, lat0 AS lat FROM road WHERE cls IN ('motorway', 'primary') UNION ALL SELECT lon1, lat1 FROM road WHERE cls IN ('motorway', 'primary')),
 rw AS (SELECT (lon - {d(LON0)}) * {KLON} * 100 AS x, (lat - {d(LAT0)}) * {KLAT} * 100 AS y FROM rv),
 near AS (SELECT DISTINCT pid FROM poly JOIN rw ON x BETWEEN cx - 50000 AND cx + 50000 AND y BETWEEN cy - 50000 AND cy + 50000
   AND sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) < sqrt(area_sqm) * 100 * {d(1.5)})"""
WET = """wet AS (SELECT DISTINCT p.pid FROM poly p JOIN box w ON w.v = 'water' AND p.glon >= w.lon - w.h AND p.glon < w.lon + w.h
   AND p.glat >= w.lat - w.h AND p.glat < w.lat + w.h)"""
FINAL = f"""{POLY}, {MAIN}, {WET}, typed AS (SELECT poly.*, near.pid IS NOT NULL AS main_road,
   CASE WHEN wet.pid IS NOT NULL THEN 'Water' ELSE land_use END AS tag_use FROM poly LEFT JOIN near USING (pid) LEFT JOIN wet USING (pid)),
 ruled AS (SELECT *, CASE WHEN area_sqm < 20000 THEN CASE WHEN main_road THEN 'Commercial' ELSE 'Residential' END ELSE 'Farmland' END AS rule_use FROM typed)"""


def raw_polygons(spark, sf):
    """Boxes with world geometry and first type; no joins."""
    w = D.with_world_geometry(V.boxes(spark, sf), LON0, LAT0)
    return w.withColumns(
        {"polygon_id": F.col("feature_id"), "land_use": category_to_type(F.col("category"), F.col("props")), "geo_vertices": F.col("coords")}
    )


def classified(spark, sf):
    polygons = D.polygons_from_vectors(V.all_features(spark, sf), LON0, LAT0)
    return C.assign_parameters(C.classify(polygons, RULES), RULES)


@query("polygon_min_area", f"WITH {POLY} SELECT pid, round(area_sqm, 4) AS area_sqm FROM poly", ("box",))
def _(spark, sf):
    p = Fl.min_area(raw_polygons(spark, sf), 800.0)
    return p.select(F.col("polygon_id").alias("pid"), r("area_sqm", 4).alias("area_sqm"))


@query("cut_sliver_filter", f"WITH {POLY} SELECT pid FROM poly0 WHERE area_sqm * 10000 > 6000000", ("box",))
def _(spark, sf):
    return Fl.without_slivers(raw_polygons(spark, sf), 6_000_000.0).select(F.col("polygon_id").alias("pid"))


@query("polygons_by_land_use", f"WITH {POLY} SELECT pid FROM poly0 WHERE land_use IN ('Forest', 'Water')", ("box",))
def _(spark, sf):
    return Fl.by_land_use(raw_polygons(spark, sf), ["Forest", "Water"]).select(F.col("polygon_id").alias("pid"))


WBOX = (100000.0, 20000.0, 9000000.0, 180000.0)


@query("polygons_in_world_box", f"WITH {POLY} SELECT pid, CAST(floor(cx / 50000) AS INT) AS cell_x, CAST(floor(cy / 50000) AS INT) AS cell_y FROM poly0 WHERE cx BETWEEN {d(WBOX[0])} AND {d(WBOX[2])} AND cy BETWEEN {d(WBOX[1])} AND {d(WBOX[3])}", ("box",))
def _(spark, sf):
    p = Fl.center_in_world_box(store.indexed(raw_polygons(spark, sf)), *WBOX)
    return p.select(F.col("polygon_id").alias("pid"), "cell_x", "cell_y")


@query("polygons_in_load_radius", f"WITH {POLY} SELECT pid FROM poly0 WHERE cx BETWEEN {d(700000 - 307200)} AND {d(700000 + 307200)} AND cy BETWEEN {d(100000 - 307200)} AND {d(100000 + 307200)}", ("box",))
def _(spark, sf):
    return Fl.in_load_radius(raw_polygons(spark, sf), 700000.0, 100000.0).select(F.col("polygon_id").alias("pid"))


@query("main_road_adjacency", f"WITH {POLY}, {MAIN} SELECT poly.pid, near.pid IS NOT NULL AS main_road FROM poly LEFT JOIN near USING (pid)", ("box", "road"))
def _(spark, sf):
    p = D.flag_main_roads(Fl.min_area(raw_polygons(spark, sf), 800.0), V.roads(spark, sf), LON0, LAT0)
    return p.select(F.col("polygon_id").alias("pid"), F.col("adjacent_main_road").alias("main_road"))


@query("polygons_in_water", f"WITH {POLY}, {WET} SELECT poly.pid, CASE WHEN wet.pid IS NOT NULL THEN 'Water' ELSE land_use END AS land_use FROM poly LEFT JOIN wet USING (pid)", ("box",))
def _(spark, sf):
    p = D.mark_water(C.with_defaults(Fl.min_area(raw_polygons(spark, sf), 800.0)), V.boxes(spark, sf))
    return p.select(F.col("polygon_id").alias("pid"), "land_use")


@query("polygons_from_vectors", f"WITH {FINAL} SELECT pid, tag_use AS land_use, main_road, round(area_sqm, 4) AS area_sqm FROM ruled", ("box", "road"))
def _(spark, sf):
    p = D.polygons_from_vectors(V.all_features(spark, sf), LON0, LAT0)
    return p.select(F.col("polygon_id").alias("pid"), "land_use", F.col("adjacent_main_road").alias("main_road"), r("area_sqm", 4).alias("area_sqm"))


@query(
    "classified_with_parameters",
    f"""WITH {FINAL} SELECT pid, rule_use AS land_use, CASE rule_use WHEN 'Residential' THEN {d(0.5)} WHEN 'Commercial' THEN {d(0.8)} WHEN 'Farmland' THEN {d(0.05)} ELSE {d(0)} END AS building_density,
    CASE rule_use WHEN 'Residential' THEN {d(0.3)} WHEN 'Farmland' THEN {d(0.9)} ELSE {d(0)} END AS vegetation_density,
    CASE rule_use WHEN 'Residential' THEN 2 WHEN 'Commercial' THEN 3 ELSE 1 END AS min_floors, CASE rule_use WHEN 'Residential' THEN 6 WHEN 'Commercial' THEN 20 ELSE 3 END AS max_floors,
    CASE WHEN main_road AND rule_use = 'Commercial' THEN {d(10)} WHEN main_road THEN {d(8)} ELSE {d(5)} END AS building_setback FROM ruled""",
    ("box", "road"),
)
def _(spark, sf):
    p = classified(spark, sf)
    return p.select(F.col("polygon_id").alias("pid"), "land_use", "building_density", "vegetation_density", "min_floors", "max_floors", "building_setback")


SLOPE, ELEV = f"(p_partkey * 31 % 200 / {d(10)})", f"(p_partkey * 17 % 7000 / {d(10)})"
AREA2, MROAD = f"(p_partkey * 13 % 40000 + {d(0.5)})", "(p_partkey % 3 = 0)"


@query(
    "classify_by_rules",
    f"""WITH p AS (SELECT p_partkey, {SLOPE} AS s, {ELEV} AS z, {AREA2} AS a, {MROAD} AS m FROM part)
    SELECT p_partkey, CASE WHEN s > 15 THEN 'Forest' WHEN z > 500 THEN 'Forest' WHEN a < 20000 AND m THEN 'Commercial' WHEN a < 20000 THEN 'Residential'
    WHEN s <= 5 AND z < 50 THEN 'Farmland' WHEN s <= 5 THEN 'Industrial' ELSE 'OpenSpace' END AS land_use FROM p""",
)
def _(spark, sf):
    p = V.table(spark, sf, "part").selectExpr("p_partkey", f"{SLOPE} AS avg_slope", f"{ELEV} AS avg_elevation", f"{AREA2} AS area_sqm", f"{MROAD} AS adjacent_main_road")
    return C.classify(p, RULES).select("p_partkey", "land_use")


@query("total_area", f"WITH {POLY} SELECT round(sum(area_sqm), 2) AS total_area_sqm FROM poly0", ("box",))
def _(spark, sf):
    return stats.total_area(raw_polygons(spark, sf)).select(r("total_area_sqm", 2).alias("total_area_sqm"))


@query("count_by_type", f"WITH {POLY} SELECT land_use, count(*) AS polygon_count FROM poly0 GROUP BY 1", ("box",))
def _(spark, sf):
    return stats.count_by_type(raw_polygons(spark, sf))


@query(
    "land_use_report",
    f"WITH {FINAL} SELECT rule_use AS land_use, count(*) AS polygon_count, round(sum(area_sqm), 3) AS area_sqm, round(sum(area_sqm) / (SELECT sum(area_sqm) FROM ruled) * 100, 6) AS pct FROM ruled GROUP BY 1",
    ("box", "road"),
)
def _(spark, sf):
    t = stats.type_report(classified(spark, sf))
    return t.select("land_use", "polygon_count", r("area_sqm", 3).alias("area_sqm"), r("pct").alias("pct"))


@query(
    "land_use_report_per_tile",
    f"""WITH {FINAL}, spot AS (SELECT pid AS event_id, glon AS lon, glat AS lat FROM ruled), {tile_sql("spot")},
    j AS (SELECT tile_col, tile_row, rule_use AS land_use, area_sqm FROM ruled JOIN u3 ON pid = event_id),
    g AS (SELECT tile_col, tile_row, land_use, count(*) AS polygon_count, sum(area_sqm) AS area_sqm FROM j GROUP BY ALL)
    SELECT tile_col, tile_row, land_use, polygon_count, round(area_sqm, 3) AS area_sqm,
    round(area_sqm / sum(area_sqm) OVER (PARTITION BY tile_col, tile_row) * 100, 6) AS pct FROM g""",
    ("box", "road"),
)
def _(spark, sf):
    p = classified(spark, sf)
    c = G.vertex_mean(F.col("geo_vertices"), "lon", "lat")
    p = V.GRID.with_tiles(p.withColumns({"g_lon": c["lon"], "g_lat": c["lat"]}), {"tile": ("g_lon", "g_lat")})
    t = stats.type_report(p, ("tile_col", "tile_row"))
    return t.select("tile_col", "tile_row", "land_use", "polygon_count", r("area_sqm", 3).alias("area_sqm"), r("pct").alias("pct"))


# Land cover: windows of every box on its block's sheet (row 0 in the north).
LC = f"""sheet AS (SELECT bc, br, max(x) + 1 AS w, max(y) + 1 AS hh FROM lc GROUP BY ALL),
 vb AS (SELECT pid, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS e FROM verts GROUP BY pid),
 blk AS (SELECT vb.*, CAST(CAST(floor(pid / 20) AS BIGINT) % 128 AS INT) AS bc, CAST(floor(floor(pid / 20) / 128) AS INT) AS br FROM vb),
 rect AS (SELECT *, {d(LON0)} + bc * {d(V.STEP)} AS x0, {d(LAT0)} + br * {d(V.STEP)} AS y0, {d(LON0)} + (bc + 1) * {d(V.STEP)} AS x1, {d(LAT0)} + (br + 1) * {d(V.STEP)} AS y1 FROM blk JOIN sheet USING (bc, br)),
 win AS (SELECT pid, bc, br, greatest(0, least(floor((a - x0) / ((x1 - x0) / w)), w - 1)) AS c0, greatest(0, least(floor((c - x0) / ((x1 - x0) / w)), w - 1)) AS c1,
   hh - 1 - greatest(0, least(floor((e - y0) / ((y1 - y0) / hh)), hh - 1)) AS r0, hh - 1 - greatest(0, least(floor((b - y0) / ((y1 - y0) / hh)), hh - 1)) AS r1 FROM rect)"""
VOTES = f"""{LC}, pv AS (SELECT pid, CASE WHEN code IN (10, 20, 95) THEN 3 WHEN code IN (30, 60, 70, 100) THEN 7 WHEN code = 40 THEN 4 WHEN code = 50 THEN 0 ELSE 5 END AS t
   FROM win JOIN lc ON lc.bc = win.bc AND lc.br = win.br AND x BETWEEN c0 AND c1 AND y BETWEEN r0 AND r1),
 cnt AS (SELECT pid, t, count(*) AS n FROM pv GROUP BY ALL),
 tot AS (SELECT pid, CAST(sum(n) AS BIGINT) AS total_votes, sum(CASE WHEN t = 5 THEN n ELSE 0 END) AS water FROM cnt GROUP BY pid),
 best AS (SELECT pid, t, row_number() OVER (PARTITION BY pid ORDER BY n DESC, t) AS k FROM cnt),
 vote AS (SELECT tot.pid, total_votes, CASE WHEN water > floor(total_votes / 3) THEN 'Water' ELSE CASE t WHEN 0 THEN 'Residential' WHEN 3 THEN 'Forest' WHEN 4 THEN 'Farmland' WHEN 5 THEN 'Water' ELSE 'OpenSpace' END END AS winner
   FROM tot JOIN best ON best.pid = tot.pid AND k = 1)"""


@query("polygon_pixel_window", f"WITH {VERTS}, {LC} SELECT pid, CAST(c0 AS INT) AS c0, CAST(c1 AS INT) AS c1, CAST(r0 AS INT) AS r0, CAST(r1 AS INT) AS r1 FROM win", ("box", "lc"))
def _(spark, sf):
    w = L.pixel_window(V.block_polygons(spark, sf), V.landcover_grids(spark, sf))
    return w.select(F.col("polygon_id").alias("pid"), "c0", "c1", "r0", "r1")


@query("landcover_votes", f"WITH {VERTS}, {VOTES} SELECT pid, total_votes, winner FROM vote", ("box", "lc"))
def _(spark, sf):
    v = L.polygon_votes(V.block_polygons(spark, sf), V.landcover_pixels(spark, sf), V.landcover_grids(spark, sf))
    return v.select(F.col("polygon_id").alias("pid"), "total_votes", "winner")


@query("fused_land_use", f"WITH {VERTS}, {VOTES} SELECT box.pid, coalesce(winner, 'Unknown') AS land_use FROM box LEFT JOIN vote USING (pid)", ("box", "lc"))
def _(spark, sf):
    f = L.fuse_landcover(V.block_polygons(spark, sf), V.landcover_pixels(spark, sf), V.landcover_grids(spark, sf))
    return f.select(F.col("polygon_id").alias("pid"), "land_use")


@query(
    "majority_class_in_window",
    """WITH c AS (SELECT bc, br, code, count(*) AS n FROM lc WHERE x BETWEEN 0 AND 6 AND y BETWEEN 2 AND 5 GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY bc, br ORDER BY n DESC, code) AS k FROM c),
    s AS (SELECT DISTINCT bc, br FROM lc) SELECT s.bc AS tile_col, s.br AS tile_row, coalesce(code, 0) AS majority FROM s LEFT JOIN b ON b.bc = s.bc AND b.br = s.br AND k = 1""",
    ("lc",),
)
def _(spark, sf):
    return L.majority_class(V.landcover_pixels(spark, sf), -2, 2, 9, 4)


@query("landcover_json_round_trip", "SELECT bc AS tile_col, br AS tile_row, x, y, code FROM lc", ("lc",))
def _(spark, sf):
    g, px = V.landcover_grids(spark, sf), V.landcover_pixels(spark, sf)
    docs = tiles.landcover_documents(px.join(g.select("tile_col", "tile_row", "width", "height"), ["tile_col", "tile_row"]), g, 0.001)
    return lc_source.parse_landcover(docs)[1]


# One raster of 125 columns over all blocks in use, as many rows as the keys need.
@query(
    "landcover_crop_to_tiles",
    f"""WITH px AS (SELECT CAST(o_orderkey % 125 AS INT) AS x, CAST(floor(o_orderkey / 125) AS INT) AS y, {V.LC_CODE} AS code FROM orders),
    g AS (SELECT (SELECT max(y) + 1 FROM px) AS h, (SELECT max(bc) + 1 FROM lc) AS nc, (SELECT max(br) + 1 FROM lc) AS nr),
    gt AS (SELECT h, nc * {d(V.STEP)} / 125 AS dx, {d(LAT0)} + nr * {d(V.STEP)} AS y0, -(nr * {d(V.STEP)} / h) AS dy FROM g),
    t AS (SELECT DISTINCT bc, br, {d(LON0)} + bc * {d(V.STEP)} AS a, {d(LAT0)} + br * {d(V.STEP)} AS b, {d(LON0)} + (bc + 1) * {d(V.STEP)} AS c, {d(LAT0)} + (br + 1) * {d(V.STEP)} AS e FROM lc),
    win AS (SELECT bc, br, greatest(0, least(CAST(trunc((a - {d(LON0)}) / dx) AS INT), 124)) AS c0, greatest(0, least(CAST(trunc((c - {d(LON0)}) / dx) AS INT), 124)) AS c1,
     greatest(0, least(CAST(trunc((e - y0) / dy) AS INT), h - 1)) AS r0, greatest(0, least(CAST(trunc((b - y0) / dy) AS INT), h - 1)) AS r1 FROM t, gt)
    SELECT bc AS tile_col, br AS tile_row, c1 - c0 AS width, r1 - r0 AS height, x - c0 AS x, y - r0 AS y, code FROM win JOIN px ON x >= c0 AND x < c1 AND y >= r0 AND y < r1""",
    ("lc",),
)
def _(spark, sf):
    px = V.table(spark, sf, "orders").selectExpr(f"{V.CELL_X} AS x", f"{V.CELL_Y} AS y", f"{V.LC_CODE} AS code")
    grids = V.landcover_grids(spark, sf)
    height = px.agg(F.max("y") + 1).first()[0]
    cols, rows = grids.agg(F.max("tile_col") + 1, F.max("tile_row") + 1).first()
    transform = (LON0, cols * V.STEP / 125, 0.0, LAT0 + rows * V.STEP, 0.0, -(rows * V.STEP / height))
    return L.crop_to_tiles(grids, px, transform, 125, height)


@query("placeholder_landcover", "SELECT bc AS tile_col, br AS tile_row, count(*) * 0 + 100 AS pixels, CAST(3000 AS BIGINT) AS code_sum FROM lc GROUP BY 1, 2", ("lc",))
def _(spark, sf):
    p = L.placeholder_landcover(V.landcover_grids(spark, sf))
    return p.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("pixels"), F.sum("code").alias("code_sum"))


@query(
    "sample_points_lattice",
    f"""WITH {POLY}, bb AS (SELECT pid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM world GROUP BY pid),
    b2 AS (SELECT bb.* FROM bb JOIN poly0 USING (pid) WHERE land_use <> 'Water'),
    ix AS (SELECT *, unnest(range(0, CAST(floor((x1 - x0) / 1000) AS BIGINT) + 1)) AS ix FROM b2),
    p AS (SELECT *, unnest(range(0, CAST(floor((y1 - y0) / 1000) AS BIGINT) + 1)) AS iy FROM ix)
    SELECT pid, round(x0 + ix * 1000, 2) AS x, round(y0 + iy * 1000, 2) AS y FROM p WHERE y0 + iy * 1000 < y1 AND x0 + ix * 1000 < x1""",
    ("box",),
)
def _(spark, sf):
    keep = ["Residential", "Commercial", "Industrial", "Forest", "Farmland", "OpenSpace", "Unknown"]
    p = sampling.sample_points(C.with_defaults(raw_polygons(spark, sf)), 10.0, None, types=keep)
    return p.select(F.col("polygon_id").alias("pid"), r("x", 2).alias("x"), r("y", 2).alias("y"))


def jitter_sql(axis: int) -> str:
    """Offset in centimetres of a lattice place ``pid, ix, iy``."""
    p = sampling.JITTER_PRIME
    at = f"(({42 * 7919 + axis} + pid % 65521 * 40503 + ix * 2654435 + iy * 97531) % {p})"
    return f"((({at} * {at} + {at} * 7) % {p} / {d(float(p))}) * {d(2.0)} - {d(1.0)}) * {d(200.0)}"


@query(
    "sample_points_jittered",
    f"""WITH {POLY}, bb AS (SELECT pid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM world GROUP BY pid),
    ix AS (SELECT *, unnest(range(0, CAST(floor((x1 - x0) / 1000) AS BIGINT) + 1)) AS ix FROM bb JOIN poly0 USING (pid)),
    g AS (SELECT *, unnest(range(0, CAST(floor((y1 - y0) / 1000) AS BIGINT) + 1)) AS iy FROM ix),
    p AS (SELECT *, x0 + ix * 1000 + {jitter_sql(104729)} AS x, y0 + iy * 1000 + {jitter_sql(1299709)} AS y FROM g)
    SELECT pid AS polygon_id, round(x, 3) AS x, round(y, 3) AS y, CASE land_use WHEN 'Residential' THEN 0 WHEN 'Forest' THEN 3 WHEN 'Farmland' THEN 4
      WHEN 'Water' THEN 5 ELSE {len(LAND_USE_TYPES) - 1} END AS land_use_type FROM p WHERE y >= y0 AND y < y1 AND x >= x0 AND x < x1""",
    ("box",),
)
def _(spark, sf):
    p = sampling.sample_points(C.with_defaults(raw_polygons(spark, sf)), 10.0, 2.0)
    return p.select("polygon_id", r("x", 3).alias("x"), r("y", 3).alias("y"), "land_use_type")


# Squares whose third corner is pulled in past the middle.
ARROW = "arrow AS (SELECT pid, i, CASE WHEN i = 2 THEN x0 + (x - x0) * {0} ELSE x END AS x, CASE WHEN i = 2 THEN y0 + (y - y0) * {0} ELSE y END AS y FROM (SELECT *, min(x) OVER p AS x0, min(y) OVER p AS y0 FROM world WHERE i < 4 WINDOW p AS (PARTITION BY pid)))".format(d(0.375))


def arrow_sql(x: str, y: str) -> str:
    """Points ``x, y`` of table ``p`` (with its ``pid``) inside the arrow of that id."""
    edges = "SELECT a.pid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM arrow a JOIN arrow b ON b.pid = a.pid AND b.i = (a.i + 3) % 4"
    return f"p JOIN ({edges}) e USING (pid) WHERE (ay > {y}) <> (by_ > {y}) AND {x} < (bx - ax) * ({y} - ay) / (by_ - ay) + ax GROUP BY pid, ix, iy HAVING count(*) % 2 = 1"


GRID = """bb AS (SELECT pid, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM arrow GROUP BY pid),
    gx AS (SELECT *, unnest(range(0, CAST(floor((x1 - x0) / 1000) AS BIGINT) + 1)) AS ix FROM bb),
    gy AS (SELECT *, unnest(range(0, CAST(floor((y1 - y0) / 1000) AS BIGINT) + 1)) AS iy FROM gx)"""


def arrows(spark, sf):
    ring = F.col("world_vertices")
    pulled = lambda c: ring[0][c] + (ring[2][c] - ring[0][c]) * 0.375
    shape = F.array(ring[0], ring[1], F.struct(pulled("x").alias("x"), pulled("y").alias("y")), ring[3])
    return raw_polygons(spark, sf).select("polygon_id", shape.alias("world_vertices"))


for _name, _reach in (("sample_points_arrows", 0.0), ("sample_points_arrows_jittered", 200.0)):
    _x, _y = ("x0 + ix * 1000", "y0 + iy * 1000") if not _reach else (f"x0 + ix * 1000 + {jitter_sql(104729)}", f"y0 + iy * 1000 + {jitter_sql(1299709)}")

    def _run(spark, sf, reach=_reach):
        p = sampling.lattice_points(arrows(spark, sf), 1000.0, reach)
        return p.select(F.col("polygon_id").alias("pid"), "ix", "iy", r("x", 3).alias("x"), r("y", 3).alias("y"))

    query(
        _name,
        f"""WITH {VERTS}, {WORLD}, {ARROW}, {GRID}, p AS (SELECT pid, ix, iy, {_x} AS px, {_y} AS py FROM gy)
        SELECT pid, ix, iy, round(any_value(px), 3) AS x, round(any_value(py), 3) AS y FROM {arrow_sql("px", "py")}""",
        ("box",),
    )(_run)


@query(
    "nearest_road_vertex",
    f"""WITH v AS (SELECT rid, lon0 * 100000 AS x, lat0 * 100000 AS y FROM road), q AS (SELECT event_id, lon * 100000 AS x, lat * 100000 AS y FROM pts),
    c AS (SELECT event_id, rid, sqrt((v.x - q.x) * (v.x - q.x) + (v.y - q.y) * (v.y - q.y)) AS dist FROM q JOIN v ON v.x BETWEEN q.x - 100 AND q.x + 100 AND v.y BETWEEN q.y - 100 AND q.y + 100),
    b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, rid) AS k FROM c WHERE dist < 100)
    SELECT event_id, rid, round(dist, 4) AS distance FROM b WHERE k = 1""",
    ("pts", "road"),
)
def _(spark, sf):
    nodes = V.table(spark, sf, "orders").selectExpr("o_orderkey AS node_id", f"{V.RD_LON0} * {d(100000)} AS x", f"{V.RD_LAT0} * {d(100000)} AS y")
    probes = V.points(spark, sf).selectExpr("event_id AS probe_id", f"lon * {d(100000)} AS x", f"lat * {d(100000)} AS y")
    n = spatial.nearest_within(probes, nodes, 100.0)
    return n.select(F.col("probe_id").alias("event_id"), F.col("node_id").alias("rid"), r("distance", 4).alias("distance"))


@query(
    "batch_outcome",
    f"""WITH t AS (SELECT bc, br, count(*) AS n FROM lc GROUP BY ALL), p AS (SELECT CAST(CAST(floor(pid / 20) AS BIGINT) % 128 AS INT) AS bc, CAST(floor(floor(pid / 20) / 128) AS INT) AS br, count(*) AS n
      FROM box WHERE v IN ('park', 'wood') AND h > {d(0.00074)} GROUP BY ALL)
    SELECT CASE WHEN p.n IS NOT NULL THEN 'success' WHEN t.bc % 4 = 0 THEN 'skipped' ELSE 'failed' END AS status, count(*) AS tiles, CAST(coalesce(sum(p.n), 0) AS BIGINT) AS polygons
    FROM t LEFT JOIN p USING (bc, br) GROUP BY 1""",
    ("lc", "box"),
)
def _(spark, sf):
    t = V.landcover_grids(spark, sf).withColumn("feature_count", F.when(F.col("tile_col") % 4 == 0, 0).otherwise(1))
    big = V.boxes(spark, sf).withColumn("h", (F.col("coords")[1]["lon"] - F.col("coords")[0]["lon"]) / 2)
    keep = big.where(F.map_values("props")[0].isin("park", "wood") & (F.col("h") > 0.00074)).select(F.col("feature_id").alias("polygon_id"))
    polys = V.block_polygons(spark, sf).join(keep, "polygon_id", "left_semi")
    return stats.batch_outcome(t, polys)
