"""Geographic views derived from the driver tables.

The tables hold no geometry, so positions come from keys by integer
arithmetic. Keys are laid out in blocks of about 2 km; more keys mean more
blocks, so the density stays the same at every scale and each query reads its
whole table. The same expression text runs in Spark and in the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import tags as K
from landloom.operators.tiling import Grid
from landloom.session import once, spread

LON0, LAT0 = 121.47, 31.23
GRID = Grid(1000.0, LON0, LAT0)
STEP = 0.02
BLOCKS_PER_ROW = 128


def d(value) -> str:
    """A DOUBLE literal both engines read alike."""
    return f"CAST({value!r} AS DOUBLE)"


def block(key: str, per_block: int) -> str:
    return f"CAST(floor({key} / {per_block}) AS BIGINT)"


def lon_of(key: str, per_block: int, mult: int = 7919, shift: int = 7) -> str:
    b = block(key, per_block)
    return f"({d(LON0)} + ({b} % {BLOCKS_PER_ROW}) * {d(STEP)} + ({key} * {mult} % 20011 + {shift}) / {d(1000000)})"


def lat_of(key: str, per_block: int, mult: int = 104729, shift: int = 9) -> str:
    b = f"CAST(floor({block(key, per_block)} / {BLOCKS_PER_ROW}) AS BIGINT)"
    return f"({d(LAT0)} + {b} * {d(STEP)} + ({key} * {mult} % 20021 + {shift}) / {d(1000000)})"


EV_LON, EV_LAT = lon_of("event_id", 100), lat_of("event_id", 100)
PT_LON, PT_LAT = lon_of("p_partkey", 20), lat_of("p_partkey", 20)
PT_H = f"((10 + p_partkey % 67) / {d(100000)})"
RD_LON0, RD_LAT0 = lon_of("o_orderkey", 150, shift=11), lat_of("o_orderkey", 150, shift=13)
RD_LON1 = f"({RD_LON0} + (o_orderkey * 31 % 4001 - 2000) / {d(1000000)})"
RD_LAT1 = f"({RD_LAT0} + (o_orderkey * 57 % 4003 - 2001) / {d(1000000)})"
RD_CLASS = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' "
    "WHEN '3' THEN 'tertiary' WHEN '4' THEN 'residential' ELSE 'unclassified' END"
)
TAG_KEY = (
    "CASE p_type WHEN 'ECONOMY' THEN 'building' WHEN 'LARGE' THEN 'landuse' WHEN 'MEDIUM' THEN 'landuse' "
    "WHEN 'PROMO' THEN 'natural' WHEN 'SMALL' THEN 'leisure' ELSE 'natural' END"
)
TAG_VALUE = (
    "CASE p_type WHEN 'ECONOMY' THEN 'yes' WHEN 'LARGE' THEN 'farmland' WHEN 'MEDIUM' THEN 'residential' "
    "WHEN 'PROMO' THEN 'water' WHEN 'SMALL' THEN 'park' ELSE 'wood' END"
)
# Elevation raster: 125 columns, as many rows as the keys need; 120-row sheets.
CELL_X, CELL_Y = "CAST(o_orderkey % 125 AS INT)", "CAST(floor(o_orderkey / 125) AS INT)"
CELL_Z = (
    f"({d(100)} + {d(80)} * sin((o_orderkey % 125) / {d(9)}) + {d(60)} * cos(floor(o_orderkey / 125) / {d(7)}))"
)
# Land-cover sheets of 15 x 10 pixels, one per 150 orders.
LC_CODES = (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100)
LC_CODE = "CASE o_custkey % 11 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(LC_CODES[:-1])) + " ELSE 100 END"
LC_BLOCK = block("o_orderkey", 150)

SQL = {
    "pts": f"pts AS (SELECT event_id, {EV_LON} AS lon, {EV_LAT} AS lat FROM events)",
    "box": (
        f"box AS (SELECT p_partkey AS pid, {PT_LON} AS lon, {PT_LAT} AS lat, {PT_H} AS h, {TAG_KEY} AS k, "
        f"{TAG_VALUE} AS v, p_type FROM part)"
    ),
    "road": (
        f"road AS (SELECT o_orderkey AS rid, {RD_LON0} AS lon0, {RD_LAT0} AS lat0, {RD_LON1} AS lon1, "
        f"{RD_LAT1} AS lat1, {RD_CLASS} AS cls FROM orders)"
    ),
    "cell": f"cell AS (SELECT {CELL_X} AS x, {CELL_Y} AS y, {CELL_Z} AS z FROM orders)",
    "lc": (
        f"lc AS (SELECT CAST({LC_BLOCK} % {BLOCKS_PER_ROW} AS INT) AS bc, "
        f"CAST(floor({LC_BLOCK} / {BLOCKS_PER_ROW}) AS INT) AS br, CAST(o_orderkey % 150 % 15 AS INT) AS x, "
        f"CAST(floor(o_orderkey % 150 / 15) AS INT) AS y, {LC_CODE} AS code FROM orders)"
    ),
}
# Ring vertices of a box, in order; the first is repeated at the end.
CORNERS = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str, name: str, key: str, *columns: str) -> DataFrame:
    """Rows of a table over all task slots: its file is small, the geometry made of a row is not."""
    return spread(table(spark, sf, name).select(key, *columns), key)


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("event_id", f"{EV_LON} AS lon", f"{EV_LAT} AS lat")


def _ring(lon, lat, h):
    return F.array(*[F.struct((lon + sx * h).alias("lon"), (lat + sy * h).alias("lat")) for sx, sy in CORNERS])


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Area features: one square per part."""
    df = dealt(spark, sf, "part", "p_partkey", "p_type").selectExpr(
        "p_partkey AS feature_id", f"{PT_LON} AS lon", f"{PT_LAT} AS lat", f"{PT_H} AS h", f"{TAG_KEY} AS k", f"{TAG_VALUE} AS v"
    )
    df = once(df, coords=_ring(F.col("lon"), F.col("lat"), F.col("h"))).withColumn("props", F.create_map("k", "v"))
    return df.select(
        "feature_id",
        F.lit("Polygon").alias("geom_type"),
        K.infer_category(F.col("props")).alias("category"),
        "coords",
        F.array("coords").alias("rings"),
        F.array(F.lit(True)).alias("ring_is_outer"),
        "props",
    )


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """Line features: one two-vertex road per order."""
    df = dealt(spark, sf, "orders", "o_orderkey", "o_orderpriority").selectExpr(
        "o_orderkey AS feature_id", f"{RD_LON0} AS lon0", f"{RD_LAT0} AS lat0", f"{RD_LON1} AS lon1", f"{RD_LAT1} AS lat1", f"{RD_CLASS} AS cls"
    )
    coords = F.array(
        F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat")),
        F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat")),
    )
    return once(df, coords=coords).withColumn("props", F.create_map(F.lit("highway"), "cls")).select(
        "feature_id",
        F.lit("LineString").alias("geom_type"),
        K.infer_category(F.col("props")).alias("category"),
        "coords",
        F.array("coords").alias("rings"),
        F.array(F.lit(True)).alias("ring_is_outer"),
        "props",
    )


def all_features(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes and roads together; road ids are shifted to stay unique."""
    lines = roads(spark, sf).withColumn("feature_id", -F.col("feature_id") - 1)
    return boxes(spark, sf).unionByName(lines)


def feature_text(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as GeoJSON text, one feature per row."""
    df = dealt(spark, sf, "part", "p_partkey", "p_type", "p_size").selectExpr(
        "p_partkey AS feature_id", f"{PT_LON} AS lon", f"{PT_LAT} AS lat", f"{PT_H} AS h", f"{TAG_KEY} AS k", f"{TAG_VALUE} AS v", "p_size"
    )
    pair = [F.array(F.col("lon") + sx * F.col("h"), F.col("lat") + sy * F.col("h")) for sx, sy in CORNERS]
    props = F.concat(
        F.lit('{"'), "k", F.lit('":"'), "v", F.lit('","size":'), F.col("p_size").cast("string"), F.lit(',"ok":true,"gone":null,"deep":{"a":1}}')
    )
    ring = F.to_json(F.array(F.array(*pair)))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    return once(df, feature=text).select("feature_id", "feature")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("'g' AS grid_id", f"{CELL_X} AS x", f"{CELL_Y} AS y", f"{CELL_Z} AS elev")


def landcover_pixels(spark: SparkSession, sf: str) -> DataFrame:
    b = LC_BLOCK
    return table(spark, sf, "orders").selectExpr(
        f"CAST({b} % {BLOCKS_PER_ROW} AS INT) AS tile_col",
        f"CAST(floor({b} / {BLOCKS_PER_ROW}) AS INT) AS tile_row",
        "CAST(o_orderkey % 150 % 15 AS INT) AS x",
        "CAST(floor(o_orderkey % 150 / 15) AS INT) AS y",
        f"{LC_CODE} AS code",
    )


def landcover_grids(spark: SparkSession, sf: str) -> DataFrame:
    """One sheet per block: 15 x 10 pixels over the block's square."""
    keys = landcover_pixels(spark, sf).groupBy("tile_col", "tile_row").agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )
    return keys.withColumns(
        {
            "min_lon": F.expr(f"{d(LON0)} + tile_col * {d(STEP)}"),
            "min_lat": F.expr(f"{d(LAT0)} + tile_row * {d(STEP)}"),
            "max_lon": F.expr(f"{d(LON0)} + (tile_col + 1) * {d(STEP)}"),
            "max_lat": F.expr(f"{d(LAT0)} + (tile_row + 1) * {d(STEP)}"),
        }
    )


def block_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes as polygons keyed by their block's sheet."""
    b = block("feature_id", 20)
    return boxes(spark, sf).selectExpr(
        "feature_id AS polygon_id",
        f"CAST({b} % {BLOCKS_PER_ROW} AS INT) AS tile_col",
        f"CAST(floor({b} / {BLOCKS_PER_ROW}) AS INT) AS tile_row",
        "coords AS geo_vertices",
        "'Unknown' AS land_use",
    )
