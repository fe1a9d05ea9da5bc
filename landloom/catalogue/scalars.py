"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from landloom.catalogue import views as V
from landloom.catalogue.registry import query, r
from landloom.catalogue.views import LAT0, LON0, d
from landloom.functions import geometry as G
from landloom.functions import projection as P
from landloom.functions import rasters as R
from landloom.functions import tags as K

WORLD_LON = f"({d(-180)} + (event_id * 7919 % 36000) / {d(100)})"
WORLD_LAT = f"({d(-80)} + (event_id * 104729 % 16000) / {d(100)})"


def world_points(spark, sf):
    return V.table(spark, sf, "events").selectExpr("event_id", f"{WORLD_LON} AS lon", f"{WORLD_LAT} AS lat")


WPTS = f"w AS (SELECT event_id, {WORLD_LON} AS lon, {WORLD_LAT} AS lat FROM events)"


@query("utm_zone", f"WITH {WPTS} SELECT event_id, CAST(floor((lon + 180) / 6) AS INT) + 1 AS zone FROM w")
def _(spark, sf):
    return world_points(spark, sf).select("event_id", P.utm_zone(F.col("lon")).alias("zone"))


A, FLAT = 6378137.0, 1.0 / 298.257223563
E2 = 2 * FLAT - FLAT**2
EP2 = E2 / (1 - E2)


def utm_forward_sql(source: str, zone: str, cubic: int, keep: str = "event_id") -> str:
    c6 = f"{cubic} * power({d(E2)}, 3)"
    return f"""
    u0 AS (SELECT *, radians(lat) AS p, {zone} AS zone FROM {source}),
    u1 AS (SELECT *, {d(A)} / sqrt(1 - {d(E2)} * power(sin(p), 2)) AS nn, power(tan(p), 2) AS t,
           {d(EP2)} * power(cos(p), 2) AS c, radians(lon - ((zone - 1) * 6 - 180 + 3)) * cos(p) AS a,
           {d(A)} * ((1 - {d(E2)} / 4 - 3 * power({d(E2)}, 2) / 64 - 5 * {c6} / 256) * p
             - (3 * {d(E2)} / 8 + 3 * power({d(E2)}, 2) / 32 + 45 * {c6} / 1024) * sin(2 * p)
             + (15 * power({d(E2)}, 2) / 256 + 45 * {c6} / 1024) * sin(4 * p)
             - (35 * {c6} / 3072) * sin(6 * p)) AS m FROM u0),
    u2 AS (SELECT *, {d(0.9996)} * nn * (a + (1 - t + c) * power(a, 3) / 6
             + (5 - 18 * t + t * t + 72 * c - 58 * {d(EP2)}) * power(a, 5) / 120) + 500000 AS e,
           {d(0.9996)} * (m + nn * tan(p) * (power(a, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * power(a, 4) / 24
             + (61 - 58 * t + t * t + 600 * c - 330 * {d(EP2)}) * power(a, 6) / 720))
             + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS n FROM u1)"""


ZONE_SQL = "CAST(floor((lon + 180) / 6) AS INT) + 1"
for _name, _series, _cubic in (("wgs84_to_utm", "full", 1), ("geo_to_utm_short_series", "short", 0)):

    def _run(spark, sf, series=_series):
        u = P.wgs84_to_utm(F.col("lon"), F.col("lat"), series=series)
        df = world_points(spark, sf).withColumn("u", u)
        return df.select("event_id", F.col("u.zone").alias("zone"), r("u.easting", 4).alias("easting"), r("u.northing", 4).alias("northing"))

    query(
        _name,
        f"WITH {WPTS}, {utm_forward_sql('w', ZONE_SQL, _cubic)} "
        "SELECT event_id, zone, round(e, 4) AS easting, round(n, 4) AS northing FROM u2",
    )(_run)

EN_E = f"({d(200000)} + (event_id * 7919 % 600000))"
EN_N = f"({d(1000000)} + (event_id * 104729 % 6000000))"


def utm_inverse_sql(last: int, cubic: int) -> str:
    e1 = f"((1 - sqrt(1 - {d(E2)})) / (1 + sqrt(1 - {d(E2)})))"
    return f"""WITH q AS (SELECT event_id, {EN_E} AS e, {EN_N} AS n FROM events),
    q0 AS (SELECT *, n / {d(0.9996)} / ({d(A)} * (1 - {d(E2)} / 4 - 3 * power({d(E2)}, 2) / 64
             - {cubic} * 5 * power({d(E2)}, 3) / 256)) AS mu FROM q),
    q1 AS (SELECT *, mu + (3 * {e1} / 2 - 27 * power({e1}, 3) / 32) * sin(2 * mu)
             + (21 * power({e1}, 2) / 16 - 55 * power({e1}, 4) / 32) * sin(4 * mu)
             + (151 * power({e1}, 3) / 96) * sin(6 * mu) + {last} * (1097 * power({e1}, 4) / 512) * sin(8 * mu) AS p FROM q0),
    q2 AS (SELECT *, {d(A)} / sqrt(1 - {d(E2)} * power(sin(p), 2)) AS n1, power(tan(p), 2) AS t,
             {d(EP2)} * power(cos(p), 2) AS c,
             {d(A)} * (1 - {d(E2)}) / power(1 - {d(E2)} * power(sin(p), 2), {d(1.5)}) AS r1 FROM q1),
    q3 AS (SELECT *, (e - 500000) / (n1 * {d(0.9996)}) AS dd FROM q2)
    SELECT event_id,
      round(((51 - 1) * 6 - 180 + 3) + degrees((dd - (1 + 2 * t + c) * power(dd, 3) / 6
        + (5 - 2 * c + 28 * t - 3 * c * c + 8 * {d(EP2)} + 24 * t * t) * power(dd, 5) / 120) / cos(p)), 9) AS lon,
      round(degrees(p - (n1 * tan(p) / r1) * (power(dd, 2) / 2
        - (5 + 3 * t + 10 * c - 4 * c * c - 9 * {d(EP2)}) * power(dd, 4) / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - 252 * {d(EP2)} - 3 * c * c) * power(dd, 6) / 720)), 9) AS lat
    FROM q3"""


for _name, _series, _flag in (("utm_to_wgs84", "full", 1), ("utm_to_geo_short_series", "short", 0)):

    def _run(spark, sf, series=_series):
        df = V.table(spark, sf, "events").selectExpr("event_id", f"{EN_E} AS e", f"{EN_N} AS n")
        g = P.utm_to_wgs84(F.col("e"), F.col("n"), 51, True, series)
        return df.withColumn("g", g).select("event_id", r("g.lon", 9).alias("lon"), r("g.lat", 9).alias("lat"))

    query(_name, utm_inverse_sql(_flag, _flag))(_run)


@query(
    "metres_per_degree",
    f"WITH {WPTS} SELECT event_id, round(cos(radians(lat)) * pi() * {d(A)} / 180, 6) AS per_lon, "
    f"round(pi() * {d(A)} / 180, 6) AS per_lat FROM w",
)
def _(spark, sf):
    return world_points(spark, sf).select(
        "event_id",
        r(P.meters_per_degree_lon(F.col("lat"))).alias("per_lon"),
        F.round(F.lit(P.meters_per_degree_lat()), 6).alias("per_lat"),
    )


WX = f"((event_id * 7919 % 2000003) - {d(1000000)})"
WY = f"((event_id * 104729 % 2000029) - {d(1000000)})"
KLON = f"(pi() / 180 * {d(6371000)} * cos(radians({d(LAT0)})))"
KLAT = f"(pi() / 180 * {d(6371000)})"


@query(
    "tile_bounds",
    f"""WITH t AS (SELECT event_id, CAST(event_id % 41 - 20 AS INT) AS c, CAST(event_id % 31 - 15 AS INT) AS w FROM events),
    k AS (SELECT *, cos(radians({d(LAT0)})) * pi() * {d(A)} / 180 AS kx, pi() * {d(A)} / 180 AS ky FROM t)
    SELECT event_id, round({d(LON0)} + c * {d(1000)} / kx, 9) AS min_lon, round({d(LAT0)} + w * {d(1000)} / ky, 9) AS min_lat,
    round({d(LON0)} + (c + 1) * {d(1000)} / kx, 9) AS max_lon, round({d(LAT0)} + (w + 1) * {d(1000)} / ky, 9) AS max_lat FROM k""",
)
def _(spark, sf):
    t = V.table(spark, sf, "events").selectExpr("event_id", "CAST(event_id % 41 - 20 AS INT) c", "CAST(event_id % 31 - 15 AS INT) w")
    b = t.withColumn("b", V.GRID.bounds_of(F.col("c"), F.col("w")))
    return b.select("event_id", *[r(f"b.{n}", 9).alias(n) for n in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(
    "geo_to_world",
    f"SELECT event_id, round((lon - {d(LON0)}) * {KLON} * 100, 4) AS x, round((lat - {d(LAT0)}) * {KLAT} * 100, 4) AS y FROM pts",
    ("pts",),
)
def _(spark, sf):
    w = V.points(spark, sf).withColumn("w", P.geo_to_world(F.col("lon"), F.col("lat"), LON0, LAT0))
    return w.select("event_id", r("w.x", 4).alias("x"), r("w.y", 4).alias("y"))


@query(
    "world_to_geo",
    f"""WITH q AS (SELECT event_id, {WX} AS x, {WY} AS y FROM events)
    SELECT event_id, round({d(LON0)} + x / 100 / {KLON}, 10) AS lon, round({d(LAT0)} + y / 100 / {KLAT}, 10) AS lat FROM q""",
)
def _(spark, sf):
    q = V.table(spark, sf, "events").selectExpr("event_id", f"{WX} AS x", f"{WY} AS y")
    g = q.withColumn("g", P.world_to_geo(F.col("x"), F.col("y"), LON0, LAT0))
    return g.select("event_id", r("g.lon", 10).alias("lon"), r("g.lat", 10).alias("lat"))


VERTS = (
    "verts AS ("
    + " UNION ALL ".join(f"SELECT pid, {i} AS i, lon + {sx} * h AS lon, lat + {sy} * h AS lat, k, v FROM box" for i, (sx, sy) in enumerate(V.CORNERS))
    + ")"
)
WORLD = f"world AS (SELECT pid, i, (lon - {d(LON0)}) * {KLON} * 100 AS x, (lat - {d(LAT0)}) * {KLAT} * 100 AS y FROM verts)"


@query("geo_array_to_world", f"WITH {VERTS}, {WORLD} SELECT pid, i AS vertex_no, round(x, 4) AS x, round(y, 4) AS y FROM world", ("box",))
def _(spark, sf):
    w = V.boxes(spark, sf).select(
        F.col("feature_id").alias("pid"), F.posexplode(P.geo_array_to_world(F.col("coords"), LON0, LAT0)).alias("vertex_no", "w")
    )
    return w.select("pid", "vertex_no", r("w.x", 4).alias("x"), r("w.y", 4).alias("y"))


@query(
    "haversine",
    f"""WITH h AS (SELECT event_id, power(sin(radians(lat - {d(LAT0)}) / 2), 2)
      + cos(radians({d(LAT0)})) * cos(radians(lat)) * power(sin(radians(lon - {d(LON0)}) / 2), 2) AS a FROM pts)
    SELECT event_id, round(6371000 * 2 * atan2(sqrt(a), sqrt(1 - a)), 4) AS metres FROM h""",
    ("pts",),
)
def _(spark, sf):
    return V.points(spark, sf).select("event_id", r(P.haversine_m(LON0, LAT0, F.col("lon"), F.col("lat")), 4).alias("metres"))


def tile_sql(source: str, out_col: str = "tile_col", out_row: str = "tile_row") -> str:
    """CTEs that end in ``u3`` with the tile of lon/lat, plus the origin ``o``."""
    origin = utm_forward_sql(f"(SELECT {d(LON0)} AS lon, {d(LAT0)} AS lat)", "51", 1)
    for n in ("u0", "u1", "u2"):
        origin = origin.replace(f"{n} AS", f"o{n} AS").replace(f"FROM {n}", f"FROM o{n}")
    return (
        utm_forward_sql(source, "51", 1)
        + ", "
        + origin
        + f", u3 AS (SELECT u2.*, CAST(floor((u2.e - ou2.e) / {d(1000)}) AS INT) AS {out_col}, "
        f"CAST(floor((u2.n - ou2.n) / {d(1000)}) AS INT) AS {out_row} FROM u2, ou2)"
    )


@query("lonlat_to_tile", f"WITH {tile_sql('pts')} SELECT event_id, tile_col, tile_row FROM u3", ("pts",))
def _(spark, sf):
    return V.GRID.with_tiles(V.points(spark, sf), {"tile": ("lon", "lat")}).select("event_id", "tile_col", "tile_row")


@query("feature_centroid", f"WITH {VERTS} SELECT pid, round(sum(lon) / 5, 9) AS lon, round(sum(lat) / 5, 9) AS lat FROM verts GROUP BY pid", ("box",))
def _(spark, sf):
    b = V.boxes(spark, sf).withColumn("c", G.feature_centroid(F.col("geom_type"), F.col("rings"), F.col("ring_is_outer")))
    return b.select(F.col("feature_id").alias("pid"), r("c.lon", 9).alias("lon"), r("c.lat", 9).alias("lat"))


@query(
    "feature_bbox",
    f"WITH {VERTS} SELECT pid, min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat FROM verts GROUP BY pid",
    ("box",),
)
def _(spark, sf):
    b = V.boxes(spark, sf).withColumn("b", G.feature_bbox(F.col("rings")))
    return b.select(F.col("feature_id").alias("pid"), "b.*")


AREA = f"""{VERTS}, {WORLD}, area AS (SELECT a.pid, sum(a.x * b.y - b.x * a.y) / 2 AS s FROM world a
  JOIN world b ON a.pid = b.pid AND b.i = (a.i + 1) % 5 GROUP BY a.pid)"""


@query("polygon_area", f"WITH {AREA} SELECT pid, round(abs(s) / 10000, 4) AS area_sqm, s < 0 AS clockwise FROM area", ("box",))
def _(spark, sf):
    w = V.boxes(spark, sf).withColumn("w", P.geo_array_to_world(F.col("coords"), LON0, LAT0))
    return w.select(F.col("feature_id").alias("pid"), r(G.area_sqm(F.col("w")), 4).alias("area_sqm"), G.is_clockwise(F.col("w")).alias("clockwise"))


@query("polygon_center", f"WITH {VERTS}, {WORLD} SELECT pid, round(sum(x) / 5, 3) AS x, round(sum(y) / 5, 3) AS y FROM world GROUP BY pid", ("box",))
def _(spark, sf):
    w = V.boxes(spark, sf).withColumn("w", P.geo_array_to_world(F.col("coords"), LON0, LAT0))
    c = w.withColumn("c", G.vertex_mean(F.col("w"), "x", "y"))
    return c.select(F.col("feature_id").alias("pid"), r("c.x", 3).alias("x"), r("c.y", 3).alias("y"))


@query(
    "polygon_world_bbox",
    f"WITH {VERTS}, {WORLD} SELECT pid, round(min(x), 4) AS min_x, round(min(y), 4) AS min_y, round(max(x), 4) AS max_x, "
    "round(max(y), 4) AS max_y FROM world GROUP BY pid",
    ("box",),
)
def _(spark, sf):
    w = V.boxes(spark, sf).withColumn("b", G.bbox(P.geo_array_to_world(F.col("coords"), LON0, LAT0), "x", "y"))
    return w.select(F.col("feature_id").alias("pid"), *[r(f"b.{n}", 4).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])


# A five-pointed outline scaled by the key, probed at a key-dependent point.
STAR = ((0, 10), (-6, -8), (10, 3), (-10, 3), (6, -8))


@query(
    "point_in_polygon",
    "WITH q AS (SELECT event_id, (event_id * 7919 % 2001) / {t} - 10 AS px, (event_id * 104729 % 2003) / {t} - 10 AS py FROM events), "
    "e(ax, ay, b_x, b_y) AS (VALUES {edges}) "
    "SELECT event_id, count(*) FILTER (WHERE (ay > py) <> (b_y > py) AND px < (b_x - ax) * (py - ay) / (b_y - ay) + ax) % 2 = 1 AS inside "
    "FROM q, e GROUP BY event_id".format(
        t=d(100), edges=", ".join(f"({d(STAR[i][0])}, {d(STAR[i][1])}, {d(STAR[i - 1][0])}, {d(STAR[i - 1][1])})" for i in range(5))
    ),
)
def _(spark, sf):
    q = V.table(spark, sf, "events").selectExpr(
        "event_id", f"(event_id * 7919 % 2001) / {d(100)} - 10 AS px", f"(event_id * 104729 % 2003) / {d(100)} - 10 AS py"
    )
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in STAR])
    return q.select("event_id", G.point_in_polygon(F.col("px"), F.col("py"), ring).alias("inside"))


SEG = [f"(o_orderkey * {m} % 211) / {d(10)}" for m in (31, 37, 41, 43, 47, 53, 59, 61)]


@query(
    "segment_intersection",
    f"""WITH q AS (SELECT o_orderkey AS k, {", ".join(f"{e} AS {n}" for e, n in zip(SEG, ("ax", "ay", "b_x", "b_y", "cx", "cy", "dx", "dy")))} FROM orders),
    m AS (SELECT *, (b_x - ax) * (dy - cy) - (b_y - ay) * (dx - cx) AS den FROM q),
    s AS (SELECT k, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den AS t, ((cx - ax) * (b_y - ay) - (cy - ay) * (b_x - ax)) / den AS u
      FROM m WHERE abs(den) >= {d(0.0001)})
    SELECT k, round(t, 9) AS t, round(u, 9) AS u FROM s
    WHERE t BETWEEN {d(-0.0001)} AND {d(1.0001)} AND u BETWEEN {d(-0.0001)} AND {d(1.0001)}""",
)
def _(spark, sf):
    names = ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")
    q = V.table(spark, sf, "orders").selectExpr("o_orderkey AS k", *[f"{e} AS {n}" for e, n in zip(SEG, names)])
    hit = q.withColumn("m", G.segment_intersection(*[F.col(n) for n in names])).where("m IS NOT NULL")
    return hit.select("k", r("m.t", 9).alias("t"), r("m.u", 9).alias("u"))


@query(
    "point_side_of_line",
    f"SELECT event_id, CAST(sign(({d(0.01)}) * (lat - {d(LAT0)}) - ({d(0.008)}) * (lon - {d(LON0)})) AS DOUBLE) AS side FROM pts",
    ("pts",),
)
def _(spark, sf):
    side = G.point_side_of_line(F.col("lon") - LON0, F.col("lat") - LAT0, F.lit(0.0), F.lit(0.0), F.lit(0.01), F.lit(0.008))
    return V.points(spark, sf).select("event_id", F.signum(side).alias("side"))


SRTM = (
    "concat(CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END, lpad(CAST(event_id % 60 AS {s}), 2, '0'), "
    "CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'E' END, lpad(CAST(event_id % 180 AS {s}), 3, '0'))"
)


@query(
    "srtm_bounds",
    "SELECT event_id, CAST((CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (event_id % 180) AS DOUBLE) AS min_lon, "
    "CAST((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (event_id % 60) AS DOUBLE) AS min_lat, "
    "CAST((CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) * (event_id % 180) + 1 AS DOUBLE) AS max_lon, "
    "CAST((CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) * (event_id % 60) + 1 AS DOUBLE) AS max_lat FROM events",
)
def _(spark, sf):
    n = V.table(spark, sf, "events").selectExpr("event_id", SRTM.format(s="STRING") + " AS name")
    b = n.withColumn("b", R.srtm_bounds(F.col("name"))).select("event_id", "b.*")
    return b.withColumns({c: F.col(c) + 0.0 for c in ("min_lon", "min_lat")})


RULES_SQL = """CASE WHEN highway IS NOT NULL THEN 'Road'
 WHEN waterway IN ('river','stream','canal','drain','ditch') THEN 'River'
 WHEN waterway IN ('riverbank','dock','boatyard') THEN 'WaterBody'
 WHEN nat = 'coastline' THEN 'Coastline' WHEN nat IN ('water','bay','strait') THEN 'WaterBody'
 WHEN nat IN ('wood','scrub','grassland','heath','wetland','beach','cliff','peak') THEN 'Natural'
 WHEN water IS NOT NULL THEN 'WaterBody' WHEN landuse IN ('reservoir','basin') THEN 'WaterBody'
 WHEN landuse IS NOT NULL THEN 'LandUse' WHEN building IS NOT NULL THEN 'Building' ELSE 'Other' END"""
TAG_POOLS = {
    "highway": ("primary", 7, 11),
    "waterway": (("river", "dock", "weir", "ditch"), 3, 13),
    "natural": (("coastline", "bay", "wood", "peak", "tree"), 5, 17),
    "water": ("lake", 11, 19),
    "landuse": (("basin", "retail", "farm", "military", "quarry", "forest"), 2, 23),
    "building": ("yes", 2, 29),
}


def _tag_value(key: str) -> str:
    """SQL for a tag that is present on some keys and cycles its values."""
    pool, every, mult = TAG_POOLS[key]
    pool = (pool,) if isinstance(pool, str) else pool
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(pool))
    return f"CASE WHEN p_partkey * {mult} % {every} = 0 THEN CASE p_partkey * {mult + 2} % {len(pool)} {cases} END END"


TAG_COLS = ", ".join(f"{_tag_value(k)} AS {'nat' if k == 'natural' else k}" for k in TAG_POOLS)


def tagged(spark, sf):
    cols = [f"{_tag_value(k)} AS `{k}`" for k in TAG_POOLS]
    df = V.table(spark, sf, "part").selectExpr("p_partkey", *cols)
    entries = F.create_map(*[x for k in TAG_POOLS for x in (F.lit(k), F.col(k))])
    return df.select("p_partkey", F.map_filter(entries, lambda _, v: v.isNotNull()).alias("props"))


@query("infer_category", f"WITH t AS (SELECT p_partkey, {TAG_COLS} FROM part) SELECT p_partkey, {RULES_SQL} AS category FROM t")
def _(spark, sf):
    return tagged(spark, sf).select("p_partkey", K.infer_category(F.col("props")).alias("category"))


@query(
    "osm_landuse_to_type",
    f"WITH t AS (SELECT p_partkey, {TAG_COLS} FROM part) SELECT p_partkey, CASE WHEN landuse IS NULL THEN 'Unknown' "
    "WHEN landuse = 'residential' THEN 'Residential' WHEN landuse IN ('commercial','retail') THEN 'Commercial' "
    "WHEN landuse = 'industrial' THEN 'Industrial' WHEN landuse = 'forest' THEN 'Forest' "
    "WHEN landuse IN ('farmland','farm') THEN 'Farmland' WHEN landuse = 'military' THEN 'Military' ELSE 'OpenSpace' END AS land_use FROM t",
)
def _(spark, sf):
    return tagged(spark, sf).select("p_partkey", K.osm_landuse_to_type(K.tag(F.col("props"), "landuse")).alias("land_use"))


Z2 = f"((o_orderkey * 7919 % 60000) / {d(100)} - 1)"
S2 = f"((o_orderkey * 104729 % 3000) / {d(100)})"
TERRAIN_SQL = """CASE WHEN z < 0.5 AND s < 1 THEN 5 WHEN z >= 300 AND s >= 15 THEN 4 WHEN z >= 300 THEN 2
 WHEN z <= 50 AND s <= 5 THEN 0 WHEN z <= 50 THEN 1 WHEN s <= 5 THEN 2 WHEN s >= 15 THEN 4 ELSE 3 END"""


@query("terrain_class", f"WITH q AS (SELECT o_orderkey, {Z2} AS z, {S2} AS s FROM orders) SELECT o_orderkey, {TERRAIN_SQL} AS terrain_class FROM q")
def _(spark, sf):
    q = V.table(spark, sf, "orders").selectExpr("o_orderkey", f"{Z2} AS z", f"{S2} AS s")
    return q.select("o_orderkey", K.terrain_class(F.col("z"), F.col("s")).alias("terrain_class"))


@query(
    "terrain_to_land_use",
    "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'Farmland' WHEN 1 THEN 'Residential' WHEN 2 THEN 'OpenSpace' "
    "WHEN 3 THEN 'Residential' WHEN 4 THEN 'Forest' WHEN 5 THEN 'Water' ELSE 'Unknown' END AS land_use FROM orders",
)
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", K.terrain_to_land_use(F.col("o_orderkey") % 7).alias("land_use"))


@query(
    "worldcover_to_land_use",
    "SELECT o_orderkey, CASE WHEN c IN (10, 20, 95) THEN 'Forest' WHEN c IN (30, 60, 70, 100) THEN 'OpenSpace' WHEN c = 40 THEN 'Farmland' "
    "WHEN c = 50 THEN 'Residential' WHEN c IN (80, 90) THEN 'Water' ELSE 'Unknown' END AS land_use "
    "FROM (SELECT o_orderkey, o_orderkey % 25 * 5 AS c FROM orders)",
)
def _(spark, sf):
    return V.table(spark, sf, "orders").select("o_orderkey", K.worldcover_to_land_use(F.col("o_orderkey") % 25 * 5).alias("land_use"))


@query(
    "worldcover_name",
    "SELECT o_orderkey, CASE c WHEN 10 THEN 'Tree cover' WHEN 20 THEN 'Shrubland' WHEN 30 THEN 'Grassland' WHEN 40 THEN 'Cropland' "
    "WHEN 50 THEN 'Built-up' WHEN 60 THEN 'Bare / sparse vegetation' WHEN 70 THEN 'Snow and ice' WHEN 80 THEN 'Permanent water bodies' "
    "WHEN 90 THEN 'Herbaceous wetland' WHEN 95 THEN 'Mangroves' WHEN 100 THEN 'Moss and lichen' END AS label "
    f"FROM (SELECT o_orderkey, {V.LC_CODE} AS c FROM orders)",
)
def _(spark, sf):
    q = V.table(spark, sf, "orders").selectExpr("o_orderkey", f"{V.LC_CODE} AS c")
    return q.select("o_orderkey", K.worldcover_name(F.col("c")).alias("label"))


@query(
    "road_weight",
    "SELECT rid, CASE cls WHEN 'motorway' THEN 100 WHEN 'primary' THEN 60 WHEN 'tertiary' THEN 20 WHEN 'residential' THEN 10 "
    "ELSE 5 END AS weight, cls IN ('motorway', 'primary') AS main_road FROM road",
    ("road",),
)
def _(spark, sf):
    h = K.tag(F.col("props"), "highway")
    return V.roads(spark, sf).select(F.col("feature_id").alias("rid"), K.road_weight(h).alias("weight"), K.is_main_road(h).alias("main_road"))


@query(
    "rect_valid_and_center",
    "SELECT event_id, (b > a) AND (d > c) AS valid, round((a + b) / 2, 6) AS lon, round((c + d) / 2, 6) AS lat FROM "
    f"(SELECT event_id, event_id % 17 / {d(7)} AS a, event_id % 13 / {d(5)} AS b, event_id % 11 / {d(3)} AS c, event_id % 19 / {d(9)} AS d FROM events)",
)
def _(spark, sf):
    q = V.table(spark, sf, "events").selectExpr(
        "event_id",
        f"named_struct('min_lon', event_id % 17 / {d(7)}, 'min_lat', event_id % 11 / {d(3)}, "
        f"'max_lon', event_id % 13 / {d(5)}, 'max_lat', event_id % 19 / {d(9)}) AS rect",
    )
    c = q.withColumn("c", P.rect_center(F.col("rect")))
    return c.select("event_id", P.rect_valid(F.col("rect")).alias("valid"), r("c.lon").alias("lon"), r("c.lat").alias("lat"))


@query(
    "world_to_cell",
    f"SELECT event_id, CAST(floor({WX} / 50000) AS INT) AS cell_x, CAST(floor({WY} / 50000) AS INT) AS cell_y FROM events",
)
def _(spark, sf):
    q = V.table(spark, sf, "events").selectExpr("event_id", f"{WX} AS x", f"{WY} AS y")
    return q.withColumn("c", P.world_to_cell(F.col("x"), F.col("y"))).select("event_id", "c.*")


@query("tile_id", "SELECT event_id, 'tile_' || (event_id % 41 - 20) || '_' || (event_id % 31 - 15) AS tile_id FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", P.tile_id(F.col("event_id") % 41 - 20, F.col("event_id") % 31 - 15).alias("tile_id"))


@query(
    "projection_codes",
    "SELECT event_id, CAST(event_id % 60 + 1 AS INT) AS zone, event_id % 2 = 0 AS north, "
    "CAST(CASE WHEN event_id % 2 = 0 THEN 32600 ELSE 32700 END + event_id % 60 + 1 AS INT) AS epsg FROM events",
)
def _(spark, sf):
    q = V.table(spark, sf, "events").select("event_id", (F.col("event_id") % 60 + 1).cast("int").alias("z"), (F.col("event_id") % 2 == 0).alias("n"))
    parsed = q.withColumn("p", P.parse_projection(P.projection_name(F.col("z"), F.col("n"))))
    return parsed.select("event_id", F.col("p.zone").alias("zone"), F.col("p.north").alias("north"), P.epsg_code(F.col("p.zone"), F.col("p.north")).alias("epsg"))


EXT = "CASE event_id % 8 WHEN 0 THEN 'tif' WHEN 1 THEN 'TIFF' WHEN 2 THEN 'hgt' WHEN 3 THEN 'png' WHEN 4 THEN 'r16' WHEN 5 THEN 'RAW' WHEN 6 THEN 'asc' ELSE '' END"


@query(
    "dem_format",
    "SELECT event_id, CASE event_id % 8 WHEN 3 THEN 'HeightmapPNG' WHEN 4 THEN 'HeightmapRAW' WHEN 5 THEN 'HeightmapRAW' ELSE 'GeoTIFF' END AS format FROM events",
)
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", K.dem_format(F.expr(EXT)).alias("format"))


@query(
    "raster_metadata",
    f"""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN round({d(0.02)} / (event_id % 5), 9) ELSE 0 END AS pixel_deg,
    round({d(0.0001)} * 111320 * cos(radians((lat + (lat + {d(0.02)})) / 2)), 2) AS cell_size_m,
    (event_id % 3 > 0) AND (event_id % 2 > 0) AS manifest_ok,
    (event_id % 5 > 0) AND (event_id % 4 > 0) AND (event_id % 7 = (event_id % 5) * (event_id % 4)) AS landcover_ok FROM pts""",
    ("pts",),
)
def _(spark, sf):
    e = F.col("event_id")
    return V.points(spark, sf).select(
        "event_id",
        r(R.pixel_size(F.lit(0.02), e % 5), 9).alias("pixel_deg"),
        R.landcover_cell_size_m(F.lit(0.0001), F.col("lat"), F.col("lat") + 0.02).alias("cell_size_m"),
        R.manifest_valid(e % 3, e % 2).alias("manifest_ok"),
        R.landcover_valid(e % 5, e % 4, e % 7).alias("landcover_ok"),
    )


@query(
    "land_use_legend",
    """WITH l(i, t, r, g, b) AS (VALUES (0,'Residential',255,235,59),(1,'Commercial',244,67,54),(2,'Industrial',255,152,0),(3,'Forest',76,175,80),
    (4,'Farmland',139,195,74),(5,'Water',33,150,243),(6,'Road',158,158,158),(7,'OpenSpace',224,224,224),(8,'Military',120,0,0),(9,'Unknown',200,200,200))
    SELECT p_partkey, t AS land_use, r, g, b FROM part JOIN l ON p_partkey % 10 = i""",
)
def _(spark, sf):
    q = V.table(spark, sf, "part").select("p_partkey", K.land_use_from_ordinal(F.col("p_partkey") % 10).alias("land_use"))
    return q.withColumn("c", K.land_use_color(F.col("land_use"))).select("p_partkey", "land_use", "c.*")


@query(
    "decode_height",
    f"""SELECT event_id, round(rr / 255 * 8848, 4) AS gray, round(-10000 + (rr * 65536 + gg * 256 + bb) * {d(0.1)}, 4) AS terrain_rgb,
    round(rr * {d(2.5)} + {d(-7)}, 4) AS linear FROM (SELECT event_id, CAST(event_id % 256 AS DOUBLE) AS rr,
    CAST(event_id * 7 % 256 AS DOUBLE) AS gg, CAST(event_id * 13 % 256 AS DOUBLE) AS bb FROM events)""",
)
def _(spark, sf):
    q = V.table(spark, sf, "events").selectExpr("event_id", "event_id % 256 AS rr", "event_id * 7 % 256 AS gg", "event_id * 13 % 256 AS bb")
    rgb = [F.col(c) for c in ("rr", "gg", "bb")]
    return q.select(
        "event_id",
        r(R.decode_height(*rgb, "gray"), 4).alias("gray"),
        r(R.decode_height(*rgb, "terrain_rgb"), 4).alias("terrain_rgb"),
        r(R.decode_height(*rgb, "linear", 2.5, -7.0), 4).alias("linear"),
    )
