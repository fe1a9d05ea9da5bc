"""Elevation, terrain zones, cutting and road networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.catalogue.registry import query, r
from landloom.catalogue.scalars import KLAT, KLON, TERRAIN_SQL, VERTS, WORLD
from landloom.catalogue.views import LAT0, LON0, d
from landloom.functions import projection as P
from landloom.functions.geometry import area_sqm
from landloom.operators import cutting, elevation, roads, spatial, stats, terrain, zones
from landloom.plans import derive as D
from landloom.schema import RECT_FIELDS, TerrainConfig
from landloom.sources import dem

CFG = TerrainConfig()

# Slope input: 3x3 neighbours with clamped edges, through window functions.
HORN = """w1 AS (SELECT x, y, z, coalesce(lag(z) OVER (PARTITION BY y ORDER BY x), z) AS l, coalesce(lead(z) OVER (PARTITION BY y ORDER BY x), z) AS rr FROM cell),
 w2 AS (SELECT x, y, z, l, rr, coalesce(lag(l) OVER c, l) AS a, coalesce(lag(z) OVER c, z) AS b, coalesce(lag(rr) OVER c, rr) AS cc,
   coalesce(lead(l) OVER c, l) AS g, coalesce(lead(z) OVER c, z) AS h, coalesce(lead(rr) OVER c, rr) AS i FROM w1 WINDOW c AS (PARTITION BY x ORDER BY y)),
 w3 AS (SELECT x, y, z, (cc + 2 * rr + i) - (a + 2 * l + g) AS gx, (g + 2 * h + i) - (a + 2 * b + cc) AS gy FROM w2),
 sl AS (SELECT x, y, z, degrees(atan(sqrt(power(gx / 240, 2) + power(gy / 240, 2)))) AS s, degrees(atan2(gy, -gx)) AS asp FROM w3)"""


@query("slope_and_aspect", f"WITH {HORN} SELECT x, y, round(s, 6) AS slope, round(CASE WHEN asp < 0 THEN asp + 360 ELSE asp END, 4) AS aspect FROM sl", ("cell",))
def _(spark, sf):
    t = terrain.slope_aspect(V.cells(spark, sf))
    return t.select("x", "y", r("slope").alias("slope"), r("aspect", 4).alias("aspect"))


@query("slope_grid_export", f"WITH {HORN} SELECT 'g' AS grid_id, x, y, round(s, 6) AS slope FROM sl", ("cell",))
def _(spark, sf):
    return terrain.slope_grid(terrain.slope_aspect(V.cells(spark, sf))).withColumn("slope", r("slope"))


@query("terrain_class_grid", f"WITH {HORN} SELECT 'g' AS grid_id, x, y, {TERRAIN_SQL} AS terrain_class FROM sl", ("cell",))
def _(spark, sf):
    return terrain.class_grid(terrain.classify_cells(terrain.slope_aspect(V.cells(spark, sf))))


# Elevation bands of 40 m stand in for zone numbers where the check is SQL.
BANDS = "band AS (SELECT x, y, z, CAST(floor(z / 40) AS BIGINT) AS zone_id FROM cell)"
NEIGH = """nb AS (SELECT a.x, a.y, a.zone_id, b.zone_id AS other, s.side FROM band a
 JOIN (VALUES (-1, 0, 0), (1, 0, 1), (0, -1, 2), (0, 1, 3)) s(dx, dy, side) ON true LEFT JOIN band b ON b.x = a.x + s.dx AND b.y = a.y + s.dy)"""


def bands(spark, sf):
    return V.cells(spark, sf).withColumns({"zone_id": F.floor(F.col("elev") / 40.0), "slope": F.col("x") / 10.0, "terrain_class": (F.col("x") % 3).cast("int")})


@query("border_cells", f"WITH {BANDS}, {NEIGH} SELECT x, y, bool_or(other IS NULL OR other <> zone_id) AS is_border FROM nb GROUP BY x, y", ("cell",))
def _(spark, sf):
    return terrain.flag_border_cells(bands(spark, sf)).select("x", "y", "is_border")


@query(
    "zone_contacts",
    f"WITH {BANDS}, {NEIGH} SELECT zone_id, other AS neighbour, count(*) AS contacts, min((CAST(y AS BIGINT) * 536870912 + x) * 4 + side) AS first_pos "
    "FROM nb WHERE other IS NOT NULL AND other <> zone_id GROUP BY 1, 2",
    ("cell",),
)
def _(spark, sf):
    return zones.zone_contacts(bands(spark, sf)).drop("grid_id")


@query("zone_sizes", f"WITH {BANDS} SELECT zone_id, count(*) AS pixels FROM band GROUP BY 1", ("cell",))
def _(spark, sf):
    return zones.zone_sizes(bands(spark, sf)).drop("grid_id")


@query(
    "zone_statistics",
    f"""WITH {BANDS}, c AS (SELECT zone_id, x % 3 AS k, count(*) AS n FROM band GROUP BY 1, 2),
    m AS (SELECT zone_id, k, row_number() OVER (PARTITION BY zone_id ORDER BY n DESC, k) AS i FROM c)
    SELECT b.zone_id, count(*) AS pixels, round(avg(z), 6) AS avg_elevation, round(avg(x / {d(10)}), 6) AS avg_slope, CAST(any_value(m.k) AS INT) AS terrain_class,
    count(*) * {d(900)} AS area_sqm FROM band b JOIN m ON m.zone_id = b.zone_id AND m.i = 1 GROUP BY 1""",
    ("cell",),
)
def _(spark, sf):
    s = zones.zone_statistics(bands(spark, sf), CFG)
    return s.select("zone_id", "pixels", r("avg_elevation").alias("avg_elevation"), r("avg_slope").alias("avg_slope"), "terrain_class", "area_sqm")


def terrain_cells(spark, sf):
    return terrain.classify_cells(terrain.slope_aspect(V.cells(spark, sf)), CFG)


# Least scan position of each area, handed from cell to cell until nothing changes.
ZONES = """tc AS (SELECT x, y, s, z, CLASS AS c FROM sl),
 lab(x, y, c, l) USING KEY (x, y) AS (SELECT x, y, c, CAST(y AS BIGINT) * 2147483648 + x FROM tc
   UNION SELECT o.x, o.y, o.c, min(n.l) FROM lab n JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dx, dy) ON true
     JOIN recurring.lab o ON o.x = n.x + s.dx AND o.y = n.y + s.dy AND o.c = n.c AND o.l > n.l GROUP BY ALL),
 zn AS (SELECT x, y, c, l, dense_rank() OVER (ORDER BY l) - 1 AS zone_id FROM lab)""".replace("CLASS", TERRAIN_SQL)


@query("connected_zones", f"WITH RECURSIVE {HORN}, {ZONES} SELECT x, y, c AS terrain_class, zone_id FROM zn", ("cell",))
def _(spark, sf):
    return zones.label_zones(terrain_cells(spark, sf)).select("x", "y", "terrain_class", "zone_id")


# Small zones one by one, in order of their ids: each goes to the neighbour group with most contacts.
SMALLEST = CFG.min_zone_area_sqm / CFG.cell_area_sqm
MERGED = f"""zs AS (SELECT zone_id AS z, count(*) AS n FROM zn GROUP BY 1),
 ct AS (SELECT a.zone_id AS a, b.zone_id AS b, count(*) AS n, min((CAST(a.y AS BIGINT) * 536870912 + a.x) * 4 + s.side) AS f
   FROM zn a JOIN (VALUES (-1, 0, 0), (1, 0, 1), (0, -1, 2), (0, 1, 3)) s(dx, dy, side) ON true JOIN zn b ON b.x = a.x + s.dx AND b.y = a.y + s.dy AND b.zone_id <> a.zone_id GROUP BY 1, 2),
 small AS (SELECT z, row_number() OVER (ORDER BY z) AS i FROM zs WHERE n < {SMALLEST}),
 mg(i, root, size) AS (SELECT 0, (SELECT list(z ORDER BY z) FROM zs), (SELECT list(n ORDER BY z) FROM zs)
   UNION ALL
   SELECT i, CASE WHEN best IS NULL THEN root ELSE list_transform(root, LAMBDA q: CASE WHEN q = z THEN best ELSE q END) END,
     CASE WHEN best IS NULL THEN size ELSE size[:best] || [size[best + 1] + size[z + 1]] || size[best + 2:] END
   FROM (SELECT t.i, t.z, any_value(t.root) AS root, any_value(t.size) AS size, arg_min(t.g, {{'c': -t.c, 'f': t.f}}) AS best
     FROM (SELECT s.i, s.z, any_value(mg.root) AS root, any_value(mg.size) AS size, mg.root[ct.b + 1] AS g, sum(ct.n) AS c, min(ct.f) AS f
       FROM mg JOIN small s ON s.i = mg.i + 1 LEFT JOIN ct ON mg.root[ct.a + 1] = s.z AND mg.root[ct.b + 1] <> s.z AND mg.size[s.z + 1] < {SMALLEST} GROUP BY s.i, s.z, mg.root[ct.b + 1]) t
     GROUP BY t.i, t.z)),
 mz AS (SELECT zn.x, zn.y, zn.c, tc.z, tc.s, (SELECT arg_max(root, i) FROM mg)[zone_id + 1] AS m FROM zn JOIN tc ON tc.x = zn.x AND tc.y = zn.y),
 mk AS (SELECT m, c, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, c) AS i FROM mz GROUP BY m, c)"""


@query(
    "terrain_zones",
    f"""WITH RECURSIVE {HORN}, {ZONES}, {MERGED} SELECT mz.m AS zone_id, count(*) AS pixels, CAST(any_value(mk.c) AS INT) AS terrain_class, count(*) * {d(CFG.cell_area_sqm)} AS area_sqm,
    round(avg(mz.z), 6) AS avg_elevation, round(avg(mz.s), 6) AS avg_slope FROM mz JOIN mk ON mk.m = mz.m AND mk.i = 1 GROUP BY mz.m HAVING count(*) * {d(CFG.cell_area_sqm)} >= {d(CFG.min_zone_area_sqm)}""",
    ("cell",),
)
def _(spark, sf):
    z = D.analyze_terrain(V.cells(spark, sf), CFG)[1]
    return z.select("zone_id", "pixels", "terrain_class", "area_sqm", r("avg_elevation").alias("avg_elevation"), r("avg_slope").alias("avg_slope"))


# Corners of a zone from the cells around each lattice point; outer rings less holes from their kinds.
@query(
    "zone_polygons",
    f"""WITH RECURSIVE {HORN}, {ZONES}, lt AS (SELECT zone_id, x + i AS vx, y + j AS vy, count(*) AS n, sum(b) AS p FROM zn JOIN (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) s(i, j, b) ON true GROUP BY 1, 2, 3),
    k AS (SELECT zone_id, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN p IN (6, 9) THEN 2 ELSE 0 END) AS corners, sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN p IN (6, 9) THEN 2 ELSE 0 END) / 4 AS euler FROM lt GROUP BY 1)
    SELECT zone_id, count(*) AS pixels, CAST(any_value(corners) AS BIGINT) AS corners, CAST(1 - any_value(euler) AS BIGINT) AS holes FROM zn JOIN k USING (zone_id) GROUP BY zone_id""",
    ("cell",),
)
def _(spark, sf):
    z = zones.zone_polygons(zones.label_zones(terrain_cells(spark, sf)))
    corners = F.size("ring") + F.aggregate("holes", F.lit(0), lambda a, h: a + F.size(h))
    return z.select("zone_id", "pixels", corners.cast("long").alias("corners"), F.size("holes").cast("long").alias("holes"))


@query("zone_outline_corners")
def _(spark, sf):
    return zones.outline_rings(bands(spark, sf).drop("slope", "terrain_class"))


# Elevation sheets of 15 x 10 pixels over each block of 150 orders, row 0 north.
SHEET = f"""px AS (SELECT {V.LC_BLOCK} AS s, CAST(o_orderkey % 150 % 15 AS INT) AS px, CAST(floor(o_orderkey % 150 / 15) AS INT) AS py, CAST(o_custkey % 3000 AS DOUBLE) AS e FROM orders),
 sh AS (SELECT s, {d(LON0)} + (s % 128) * {d(V.STEP)} AS x0, {d(LAT0)} + floor(s / 128) * {d(V.STEP)} AS y0,
   {d(LON0)} + (s % 128 + 1) * {d(V.STEP)} AS x1, {d(LAT0)} + (floor(s / 128) + 1) * {d(V.STEP)} AS y1, max(px) + 1 AS w, max(py) + 1 AS h FROM px GROUP BY s)"""


def sheets(spark, sf):
    """``(tiles, pixels)`` of the elevation sheets."""
    pixels = V.table(spark, sf, "orders").selectExpr(
        f"CAST({V.LC_BLOCK} AS STRING) AS dem_id", "CAST(o_orderkey % 150 % 15 AS INT) AS px", "CAST(floor(o_orderkey % 150 / 15) AS INT) AS py",
        "CAST(o_custkey % 3000 AS FLOAT) AS elev",
    )
    t = pixels.groupBy("dem_id").agg((F.max("px") + 1).alias("width"), (F.max("py") + 1).alias("height")).withColumn("tile_ord", F.col("dem_id").cast("long"))
    exprs = [f"{d(LON0)} + (tile_ord % 128) * {d(V.STEP)} AS min_lon", f"{d(LAT0)} + floor(tile_ord / 128) * {d(V.STEP)} AS min_lat",
             f"{d(LON0)} + (tile_ord % 128 + 1) * {d(V.STEP)} AS max_lon", f"{d(LAT0)} + (floor(tile_ord / 128) + 1) * {d(V.STEP)} AS max_lat"]
    return t.selectExpr("*", *exprs), pixels


LOCATE = """loc AS (SELECT p.*, sh.*, row_number() OVER (PARTITION BY p.id ORDER BY sh.s) AS k FROM p LEFT JOIN sh ON lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1),
 at_px AS (SELECT *, greatest(0, least(floor((lon - x0) / (x1 - x0) * w), w - 1)) AS qx, greatest(0, least(floor((1 - (lat - y0) / (y1 - y0)) * h), h - 1)) AS qy FROM loc WHERE k = 1)"""


@query("elevation_nearest", f"WITH p AS (SELECT event_id AS id, lon, lat FROM pts), {SHEET}, {LOCATE} SELECT id AS event_id, e AS elev FROM at_px LEFT JOIN px ON px.s = at_px.s AND px.px = qx AND px.py = qy", ("pts",))
def _(spark, sf):
    return elevation.sample_nearest(V.points(spark, sf), *sheets(spark, sf)).select("event_id", "elev")


@query(
    "elevation_first_tile",
    f"""WITH {SHEET}, f AS (SELECT * FROM sh WHERE s = 0), q AS (SELECT event_id, greatest(0, least(floor((lon - x0) / (x1 - x0) * w), w - 1)) AS qx,
    greatest(0, least(floor((1 - (lat - y0) / (y1 - y0)) * h), h - 1)) AS qy FROM pts, f) SELECT event_id, e AS elev FROM q JOIN px ON s = 0 AND px = qx AND py = qy""",
    ("pts",),
)
def _(spark, sf):
    return elevation.sample_first_tile(V.points(spark, sf), *sheets(spark, sf)).select("event_id", "elev")


@query(
    "elevation_bilinear",
    f"""WITH p AS (SELECT event_id AS id, lon, lat FROM pts), {SHEET}, {LOCATE},
    f AS (SELECT *, (lon - x0) / (x1 - x0) * w - 0.5 AS fx, (1 - (lat - y0) / (y1 - y0)) * h - 0.5 AS fy FROM at_px),
    g AS (SELECT *, greatest(0, least(floor(fx), w - 2)) AS gx, greatest(0, least(floor(fy), h - 2)) AS gy FROM f)
    SELECT id AS event_id, round((a.e + (b.e - a.e) * (fx - gx)) + ((c.e + (t.e - c.e) * (fx - gx)) - (a.e + (b.e - a.e) * (fx - gx))) * (fy - gy), 4) AS elev
    FROM g LEFT JOIN px a ON a.s = g.s AND a.px = gx AND a.py = gy LEFT JOIN px b ON b.s = g.s AND b.px = gx + 1 AND b.py = gy
    LEFT JOIN px c ON c.s = g.s AND c.px = gx AND c.py = gy + 1 LEFT JOIN px t ON t.s = g.s AND t.px = gx + 1 AND t.py = gy + 1""",
    ("pts",),
)
def _(spark, sf):
    return elevation.sample_bilinear(V.points(spark, sf), *sheets(spark, sf)).select("event_id", r("elev", 4).alias("elev"))


@query(
    "elevation_tile_resample",
    f"""WITH {SHEET}, p AS (SELECT t.s AS ts, i.x, j.y, x0 + (i.x + 0.5) * ((x1 - x0) / 6) AS lon, y1 - (j.y + 0.5) * ((y1 - y0) / 6) AS lat, t.s * 36 + j.y * 6 + i.x AS id
      FROM sh t, range(6) i(x), range(6) j(y)), {LOCATE} SELECT CAST(ts % 128 AS INT) AS tile_col, CAST(floor(ts / 128) AS INT) AS tile_row, CAST(x AS INT) AS x, CAST(y AS INT) AS y, e AS elev
    FROM at_px LEFT JOIN px ON px.s = at_px.s AND px.px = qx AND px.py = qy""",
)
def _(spark, sf):
    t, px = sheets(spark, sf)
    targets = t.withColumns({"tile_col": (F.col("tile_ord") % 128).cast("int"), "tile_row": F.floor(F.col("tile_ord") / 128).cast("int")})
    return elevation.resample_tiles(targets.select("tile_col", "tile_row", *RECT_FIELDS), t, px, 6)


GRID_M = 200.0


@query(
    "elevation_analysis_grid",
    f"""WITH {SHEET}, b AS (SELECT min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM sh),
    n AS (SELECT *, greatest(1, CAST(ceil((bx1 - bx0) * ({d(111320.0)} * cos(radians((by0 + by1) / {d(2.0)}))) / {d(GRID_M)}) AS BIGINT)) AS nx,
      greatest(1, CAST(ceil((by1 - by0) * {d(110540.0)} / {d(GRID_M)}) AS BIGINT)) AS ny FROM b),
    c AS (SELECT *, unnest(range(0, nx * ny)) AS id FROM n),
    p AS (SELECT id, CAST(id % nx AS INT) AS gx, CAST(id // nx AS INT) AS gy, bx0 + (id % nx + {d(0.5)}) * ((bx1 - bx0) / nx) AS lon, by0 + (id // nx + {d(0.5)}) * ((by1 - by0) / ny) AS lat FROM c), {LOCATE}
    SELECT gx AS x, gy AS y, e AS elev FROM at_px LEFT JOIN px ON px.s = at_px.s AND px.px = qx AND px.py = qy""",
)
def _(spark, sf):
    t, px = sheets(spark, sf)
    b = tuple(t.agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")).first())
    return elevation.elevation_grid(spark, t, px, b, GRID_M).select("x", "y", "elev")


def _binary(spark, sf, ext: str, head: str):
    """Sheets as raster files: little-endian 16-bit values in one binary."""
    v = "o_custkey % 3000"
    hexed = f"concat(lpad(hex({v} % 256), 2, '0'), lpad(hex(CAST(floor(({v}) / 256) AS BIGINT)), 2, '0'))"
    rows = V.table(spark, sf, "orders").selectExpr(f"{V.LC_BLOCK} AS s", "o_orderkey % 150 AS i", f"{hexed} AS h")
    packed = rows.groupBy("s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda q: q["h"]), "").alias("h"))
    return packed.select(F.concat(F.lit("sheet_"), F.col("s").cast("string"), F.lit(f".{ext}")).alias("path"), F.unhex(F.concat(F.lit(head), "h")).alias("content"))


for _ext, _head in (("raw", ""), ("tif", "49492A00")):

    def _run(spark, sf, ext=_ext, head=_head):
        return dem.decode(_binary(spark, sf, ext, head), 15, 10).select("dem_id", "px", "py", F.col("elev").cast("double").alias("elev"))

    query(f"decode_{_ext}_raster", f"WITH {SHEET} SELECT 'sheet_' || s || '.{_ext}' AS dem_id, px, py, e AS elev FROM px")(_run)

WSEG = f"""seg AS (SELECT rid, (lon0 - {d(LON0)}) * {KLON} * 100 AS x0, (lat0 - {d(LAT0)}) * {KLAT} * 100 AS y0, (lon1 - {d(LON0)}) * {KLON} * 100 AS x1, (lat1 - {d(LAT0)}) * {KLAT} * 100 AS y1 FROM road)"""


@query("polyline_segments", "SELECT rid, 0 AS seg_no, lon0, lat0, lon1, lat1 FROM road", ("road",))
def _(spark, sf):
    s = roads.polyline_segments(V.roads(spark, sf), ["feature_id"])
    return s.select(F.col("feature_id").alias("rid"), "seg_no", F.col("a.lon").alias("lon0"), F.col("a.lat").alias("lat0"), F.col("b.lon").alias("lon1"), F.col("b.lat").alias("lat1"))


@query(
    "cut_line_candidates",
    f"""WITH {VERTS}, {WORLD}, {WSEG}, o AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS ord FROM seg WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) >= 1),
    bb AS (SELECT pid, min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS e FROM world GROUP BY pid)
    SELECT pid, ord FROM bb JOIN o ON least(x0, x1) <= c AND greatest(x0, x1) >= a AND least(y0, y1) <= e AND greatest(y0, y1) >= b""",
    ("box", "road"),
)
def _(spark, sf):
    segs = cutting.cut_segments(V.roads(spark, sf), LON0, LAT0)
    p = V.boxes(spark, sf).select(F.col("feature_id").alias("piece_id"), F.lit(-1).alias("after"), P.geo_array_to_world(F.col("coords"), LON0, LAT0).alias("world_vertices"))
    return cutting.candidate_segments(p, segs).select(F.col("piece_id").alias("pid"), "ord")


# The first segment that crosses two edges splits a piece; its parts go on with the later ones.
ENDS = cutting.EDGE_MARGIN, 1.0 - cutting.EDGE_MARGIN
PIECES = f"""o AS (SELECT *, row_number() OVER (ORDER BY rid) - 1 AS ord FROM seg WHERE (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) >= 1),
 pc(pid, name, aft, pts) AS (SELECT pid, pid::VARCHAR, -1::BIGINT, list({{'x': x, 'y': y}} ORDER BY i) FROM world WHERE i < 4 GROUP BY pid
   UNION ALL
   SELECT pid, name || '.' || ord || sd, ord, list({{'x': px, 'y': py}} ORDER BY i, k) FROM (
     SELECT *, CASE WHEN k = 0 THEN ax ELSE ax + (bx - ax) * greatest(0, least(1, t)) END AS px, CASE WHEN k = 0 THEN ay ELSE ay + (by_ - ay) * greatest(0, least(1, t)) END AS py FROM (
       SELECT *, CASE WHEN sd = 'l' THEN sa >= -{d(1e-4)} ELSE sa <= {d(1e-4)} END AS keep, CASE WHEN sd = 'l' THEN sb >= -{d(1e-4)} ELSE sb <= {d(1e-4)} END AS keep2,
         CASE WHEN abs(den) >= {d(1e-4)} THEN ((ex0 - ax) * (ey1 - ey0) - (ey0 - ay) * (ex1 - ex0)) / den END AS t, CASE WHEN abs(den) >= {d(1e-4)} THEN ((ex0 - ax) * (by_ - ay) - (ey0 - ay) * (bx - ax)) / den END AS u FROM (
         SELECT *, (ex1 - ex0) * (ay - ey0) - (ey1 - ey0) * (ax - ex0) AS sa, (ex1 - ex0) * (by_ - ey0) - (ey1 - ey0) * (bx - ex0) AS sb, (bx - ax) * (ey1 - ey0) - (by_ - ay) * (ex1 - ex0) AS den FROM (
           SELECT pid, name, ord, i, pts[i].x AS ax, pts[i].y AS ay, pts[i % len(pts) + 1].x AS bx, pts[i % len(pts) + 1].y AS by_,
             x0 - (x1 - x0) / h * {d(cutting.EXTENSION_CM)} AS ex0, y0 - (y1 - y0) / h * {d(cutting.EXTENSION_CM)} AS ey0, x1 + (x1 - x0) / h * {d(cutting.EXTENSION_CM)} AS ex1, y1 + (y1 - y0) / h * {d(cutting.EXTENSION_CM)} AS ey1
           FROM (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS h, unnest(range(1, len(pts) + 1)) AS i FROM (
             SELECT pid, name, ord, pts, x0, y0, x1, y1, row_number() OVER (PARTITION BY name ORDER BY ord) AS rn FROM pc JOIN o ON ord > aft
               AND least(x0, x1) <= list_max([q.x FOR q IN pts]) AND greatest(x0, x1) >= list_min([q.x FOR q IN pts]) AND least(y0, y1) <= list_max([q.y FOR q IN pts]) AND greatest(y0, y1) >= list_min([q.y FOR q IN pts])
             WHERE len([v FOR v IN range(1, len(pts) + 1) IF {{edge}}]) >= 2) WHERE rn = 1))), (VALUES ('l'), ('r')) sides(sd)), (VALUES (0), (1)) ks(k))
   WHERE CASE WHEN k = 0 THEN keep ELSE keep <> keep2 AND t BETWEEN -{d(1e-4)} AND 1 + {d(1e-4)} AND u BETWEEN -{d(1e-4)} AND 1 + {d(1e-4)} END
   GROUP BY pid, name, ord, sd)"""
_A, _B = "pts[v]", "pts[v % len(pts) + 1]"
_DEN = f"(({_B}.x - {_A}.x) * (y1 - y0) - ({_B}.y - {_A}.y) * (x1 - x0))"
_T, _U = f"((x0 - {_A}.x) * (y1 - y0) - (y0 - {_A}.y) * (x1 - x0)) / {_DEN}", f"((x0 - {_A}.x) * ({_B}.y - {_A}.y) - (y0 - {_A}.y) * ({_B}.x - {_A}.x)) / {_DEN}"
PIECES = PIECES.replace("{edge}", f"abs({_DEN}) >= {d(1e-4)} AND {_T} > {d(ENDS[0])} AND {_T} < {d(ENDS[1])} AND {_U} > {d(ENDS[0])} AND {_U} < {d(ENDS[1])}")


@query(
    "polygons_cut_by_roads",
    f"""WITH RECURSIVE {VERTS}, {WORLD}, {WSEG}, {PIECES}, whole AS (SELECT * FROM pc ANTI JOIN (SELECT DISTINCT regexp_replace(name, '[.][0-9]+[lr]$', '') AS up FROM pc WHERE aft >= 0) q ON pc.name = q.up),
    s AS (SELECT pid, name, len(pts) AS n, abs(list_sum([pts[v].x * pts[v % len(pts) + 1].y - pts[v % len(pts) + 1].x * pts[v].y FOR v IN range(1, len(pts) + 1)])) / 2 AS sq FROM whole)
    SELECT pid AS polygon_id, name AS piece_id, n AS vertices, round(sq / 10000, 3) AS area_sqm FROM s WHERE sq > 100""",
    ("box", "road"),
)
def _(spark, sf):
    segs = cutting.cut_segments(V.roads(spark, sf), LON0, LAT0)
    p = V.boxes(spark, sf).select(F.col("feature_id").alias("polygon_id"), P.geo_array_to_world(F.slice("coords", 1, 4), LON0, LAT0).alias("world_vertices"))
    c = cutting.cut_polygons(p, segs)
    return c.select("polygon_id", "piece_id", F.size("world_vertices").alias("vertices"), r(area_sqm(F.col("world_vertices")), 3).alias("area_sqm"))


USEG = "useg AS (SELECT rid AS k, lon0 * 100000 AS x0, lat0 * 100000 AS y0, lon1 * 100000 AS x1, lat1 * 100000 AS y1 FROM road)"
CROSS = f"""{USEG}, cr AS (SELECT a.k AS a_id, b.k AS b_id, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS den,
   (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) AS tn, (b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0) AS un,
   a.x0 AS ax, a.y0 AS ay, a.x1 - a.x0 AS dx, a.y1 - a.y0 AS dy FROM useg a JOIN useg b ON a.k < b.k AND floor(a.k / 150) BETWEEN floor(b.k / 150) - 129 AND floor(b.k / 150)
   AND least(a.x0, a.x1) <= greatest(b.x0, b.x1) AND greatest(a.x0, a.x1) >= least(b.x0, b.x1) AND least(a.y0, a.y1) <= greatest(b.y0, b.y1) AND greatest(a.y0, a.y1) >= least(b.y0, b.y1)),
 hit AS (SELECT a_id, b_id, tn / den AS t, un / den AS u, ax + dx * (tn / den) AS x, ay + dy * (tn / den) AS y FROM cr WHERE abs(den) >= {d(0.0001)}
   AND tn / den > {d(0.001)} AND tn / den < {d(0.999)} AND un / den > {d(0.001)} AND un / den < {d(0.999)})"""


def crossings(spark, sf):
    seg = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS seg_id", "o_orderkey * 2 AS n0", "o_orderkey * 2 + 1 AS n1", f"{V.RD_LON0} * {d(100000)} AS x0", f"{V.RD_LAT0} * {d(100000)} AS y0",
        f"{V.RD_LON1} * {d(100000)} AS x1", f"{V.RD_LAT1} * {d(100000)} AS y1",
    )
    return spatial.crossing_segments(seg, 250.0)


@query("road_crossings", f"WITH {CROSS} SELECT a_id, b_id, round(t, 6) AS t, round(u, 6) AS u, round(x, 3) AS x, round(y, 3) AS y FROM hit", ("road",))
def _(spark, sf):
    c = crossings(spark, sf)
    return c.select("a_id", "b_id", r("t").alias("t"), r("u").alias("u"), r("x", 3).alias("x"), r("y", 3).alias("y"))


@query(
    "edge_split_points",
    f"""WITH {CROSS}, e AS (SELECT a_id AS edge_id, t, x, y FROM hit UNION ALL SELECT b_id, u, x, y FROM hit),
    g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM e WINDOW w AS (PARTITION BY edge_id ORDER BY t, x, y))
    SELECT edge_id, round(t, 6) AS t, round(x, 3) AS x, round(y, 3) AS y FROM g WHERE px IS NULL OR (x - px) * (x - px) + (y - py) * (y - py) >= 1""",
    ("road",),
)
def _(spark, sf):
    s = roads.split_points(crossings(spark, sf))
    return s.select("edge_id", r("t").alias("t"), r("x", 3).alias("x"), r("y", 3).alias("y"))


NX, NY = "CAST({k} * 7919 % 20011 AS DOUBLE)", "CAST({k} * 104729 % 20021 AS DOUBLE)"


@query(
    "leftmost_turns",
    f"""WITH e AS (SELECT a.o_orderkey AS edge_id, a.o_custkey AS n0, b.o_custkey AS n1 FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey),
    p AS (SELECT *, {NX.format(k='n0')} AS x0, {NY.format(k='n0')} AS y0, {NX.format(k='n1')} AS x1, {NY.format(k='n1')} AS y1 FROM e),
    a AS (SELECT n0 AS node_id, edge_id, true AS fwd, atan2(y1 - y0, x1 - x0) AS ang FROM p UNION ALL SELECT n1, edge_id, false, atan2(y0 - y1, x0 - x1) FROM p),
    n AS (SELECT *, coalesce(lead(edge_id) OVER w, first_value(edge_id) OVER w) AS nxt, coalesce(lead(fwd) OVER w, first_value(fwd) OVER w) AS nf, count(*) OVER (PARTITION BY node_id) AS deg
      FROM a WINDOW w AS (PARTITION BY node_id ORDER BY ang, edge_id))
    SELECT node_id, edge_id, NOT fwd AS forward, nxt AS next_edge_id, nf AS next_forward FROM n WHERE deg >= 2""",
)
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("n1"))
    edges = o.join(nxt, "o_orderkey").where("o_custkey <> n1").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("n0"), "n1")
    nodes = o.select(F.col("o_custkey").alias("node_id")).distinct().selectExpr("node_id", NX.format(k="node_id") + " AS x", NY.format(k="node_id") + " AS y")
    return roads.leftmost_turns(nodes, edges)


# First-come merging: a vertex leads if no earlier vertex in reach leads. State 0 open, 1 leader, 2 merged.
NODES = """rv AS (SELECT rid * 2 AS o, lon0 AS lon, lat0 AS lat FROM road UNION ALL SELECT rid * 2 + 1, lon1, lat1 FROM road),
 sp AS (SELECT lon * 100000 AS x, lat * 100000 AS y, min(o) AS o, floor(lon * 100000 / 100) AS cx, floor(lat * 100000 / 100) AS cy FROM rv GROUP BY ALL),
 rim AS (SELECT *, cx + i AS kx, cy + j AS ky FROM sp, range(-1, 2) a(i), range(-1, 2) b(j)),
 reach AS (SELECT a.o AS later, b.o AS earlier FROM rim a JOIN sp b ON b.cx = a.kx AND b.cy = a.ky AND b.o < a.o WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 10000),
 st(o, s) USING KEY (o) AS (SELECT o, CASE WHEN o IN (SELECT later FROM reach) THEN 0 ELSE 1 END FROM sp
   UNION SELECT a.o, CASE WHEN bool_or(n.s = 1) THEN 2 ELSE 1 END FROM recurring.st a JOIN reach ON a.o = later JOIN recurring.st n ON n.o = earlier
     WHERE a.s = 0 GROUP BY a.o HAVING bool_or(n.s = 1) OR bool_and(n.s = 2))"""


@query(
    "road_graph_nodes",
    f"WITH RECURSIVE {NODES} SELECT row_number() OVER (ORDER BY o) - 1 AS node_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM st JOIN rv USING (o) WHERE s = 1",
    ("road",),
)
def _(spark, sf):
    nodes, _e = roads.build_graph(V.roads(spark, sf))
    return nodes.select("node_id", r("lon").alias("lon"), r("lat").alias("lat"))


def first_come(points: str, tolerance: float, tag: str) -> str:
    """First-come merging of table ``points(o, x, y)`` (distinct positions): tables ``{tag}_st(o, s)`` and ``{tag}_to(o, leader)``."""
    return f"""{tag}_c AS (SELECT *, floor(x / {d(tolerance)}) AS cx, floor(y / {d(tolerance)}) AS cy FROM {points}),
 {tag}_r AS (SELECT a.o AS later, b.o AS earlier, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS q FROM (SELECT *, cx + i AS kx, cy + j AS ky FROM {tag}_c, range(-1, 2) f(i), range(-1, 2) g(j)) a
   JOIN {tag}_c b ON b.cx = a.kx AND b.cy = a.ky AND b.o < a.o WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {d(tolerance * tolerance)}),
 {tag}_st(o, s) USING KEY (o) AS (SELECT o, CASE WHEN o IN (SELECT later FROM {tag}_r) THEN 0 ELSE 1 END FROM {points}
   UNION SELECT a.o, CASE WHEN bool_or(n.s = 1) THEN 2 ELSE 1 END FROM recurring.{tag}_st a JOIN {tag}_r ON a.o = later JOIN recurring.{tag}_st n ON n.o = earlier
     WHERE a.s = 0 GROUP BY a.o HAVING bool_or(n.s = 1) OR bool_and(n.s = 2)),
 {tag}_to AS (SELECT o, o AS leader FROM {tag}_st WHERE s = 1
   UNION ALL SELECT later, arg_min(earlier, {{'q': q, 'e': earlier}}) FROM {tag}_r JOIN {tag}_st e ON e.o = earlier AND e.s = 1 JOIN {tag}_st l ON l.o = later AND l.s = 2 GROUP BY later)"""


def nearby(left: str, right: str, size: float) -> str:
    """Cells of points: joins ``left(x, y)`` with ``right(x, y)`` in the nine cells around."""
    return f"(SELECT *, floor(x / {d(size)}) + i AS kx, floor(y / {d(size)}) + j AS ky FROM {left}, range(-1, 2) f(i), range(-1, 2) g(j)) a JOIN (SELECT *, floor(x / {d(size)}) AS kx, floor(y / {d(size)}) AS ky FROM {right}) b USING (kx, ky)"


SPLIT = roads.SPLIT_TOLERANCE
GRAPH = f"""rv AS (SELECT rid * 2 AS o, lon0 * 100000 AS x, lat0 * 100000 AS y FROM road UNION ALL SELECT rid * 2 + 1, lon1 * 100000, lat1 * 100000 FROM road),
 sp AS (SELECT min(o) AS o, x, y FROM rv GROUP BY x, y), {first_come("sp", roads.MERGE_TOLERANCE, "m")},
 node AS (SELECT o, x, y, row_number() OVER (ORDER BY o) - 1 AS node_id FROM sp JOIN m_st USING (o) WHERE s = 1),
 vx AS (SELECT rv.o, n.node_id, n.x, n.y FROM rv JOIN sp ON sp.x = rv.x AND sp.y = rv.y JOIN m_to ON m_to.o = sp.o JOIN node n ON n.o = m_to.leader),
 ed AS (SELECT row_number() OVER (ORDER BY a.o) - 1 AS e, a.node_id AS n0, b.node_id AS n1, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM vx a JOIN vx b ON b.o = a.o + 1 AND a.o % 2 = 0 WHERE a.node_id <> b.node_id),
 ec AS (SELECT *, unnest(range(CAST(floor(least(y0, y1) / 1000) AS BIGINT), CAST(floor(greatest(y0, y1) / 1000) AS BIGINT) + 1)) AS cy
   FROM (SELECT *, unnest(range(CAST(floor(least(x0, x1) / 1000) AS BIGINT), CAST(floor(greatest(x0, x1) / 1000) AS BIGINT) + 1)) AS cx FROM ed)),
 pr AS (SELECT DISTINCT a.e AS ae, b.e AS be FROM ec a JOIN ec b USING (cx, cy) WHERE a.e < b.e AND a.n0 <> b.n0 AND a.n0 <> b.n1 AND a.n1 <> b.n0 AND a.n1 <> b.n1),
 cr AS (SELECT ae, be, (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS den, (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) AS tn,
   (b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0) AS un, a.x0 AS ax, a.y0 AS ay, a.x1 - a.x0 AS dx, a.y1 - a.y0 AS dy FROM pr JOIN ed a ON a.e = ae JOIN ed b ON b.e = be),
 hit AS (SELECT ae, be, tn / den AS t, un / den AS u, ax + dx * (tn / den) AS x, ay + dy * (tn / den) AS y FROM cr WHERE abs(den) >= {d(0.0001)}
   AND tn / den > {d(0.001)} AND tn / den < {d(0.999)} AND un / den > {d(0.001)} AND un / den < {d(0.999)}),
 po AS (SELECT ae AS e, t, x, y FROM hit UNION ALL SELECT be, u, x, y FROM hit),
 kp AS (SELECT e, t, x, y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM po WINDOW w AS (PARTITION BY e ORDER BY t, x, y)) WHERE px IS NULL OR (x - px) * (x - px) + (y - py) * (y - py) >= 1),
 pb AS (SELECT *, row_number() OVER (ORDER BY e, t, x, y) - 1 AS o FROM kp),
 old AS (SELECT a.o, arg_min(b.node_id, {{'q': sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'n': b.node_id}}) AS node_id FROM {nearby("pb", "node", SPLIT)}
   WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < {d(SPLIT)} GROUP BY a.o),
 fr AS (SELECT min(o) AS o, x, y FROM pb WHERE o NOT IN (SELECT o FROM old) GROUP BY x, y), {first_come("fr", SPLIT, "f")},
 nw AS (SELECT o, row_number() OVER (ORDER BY o) - 1 + (SELECT coalesce(max(node_id), -1) + 1 FROM node) AS node_id FROM f_st WHERE s = 1),
 pn AS (SELECT o, node_id FROM old UNION ALL SELECT pb.o, nw.node_id FROM pb JOIN fr ON fr.x = pb.x AND fr.y = pb.y JOIN f_to ON f_to.o = fr.o JOIN nw ON nw.o = f_to.leader WHERE pb.o NOT IN (SELECT o FROM old)),
 sq AS (SELECT e, o AS k, node_id FROM pb JOIN pn USING (o) UNION ALL SELECT e, -1, n0 FROM ed UNION ALL SELECT e, 1000000000, n1 FROM ed),
 ch AS (SELECT e, k, node_id AS n0, lead(node_id) OVER (PARTITION BY e ORDER BY k) AS n1 FROM sq),
 live AS (SELECT row_number() OVER (ORDER BY e, k) - 1 AS edge_id, n0, n1, e AS source_edge_id FROM ch WHERE n1 IS NOT NULL AND n1 <> n0)"""


@query("road_graph_edges", f"WITH RECURSIVE {GRAPH} SELECT edge_id, n0, n1, source_edge_id FROM live", ("road",))
def _(spark, sf):
    n, e = roads.build_graph(V.roads(spark, sf))
    return roads.split_at_crossings(n, e)[1].select("edge_id", "n0", "n1", "source_edge_id")


@query(
    "road_graph_split",
    f"WITH RECURSIVE {GRAPH} SELECT (SELECT count(*) FROM node) + (SELECT count(*) FROM nw) AS nodes, (SELECT count(*) FROM live) AS edges",
    ("road",),
)
def _(spark, sf):
    n, e = roads.build_graph(V.roads(spark, sf))
    return stats.graph_counts(*roads.split_at_crossings(n, e))
