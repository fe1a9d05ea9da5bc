"""GeoJSON reader.

Newline-delimited features are split by Spark's text source; FeatureCollection
files are read in byte ranges, too (``geojson_ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landloom.functions import tags as K
from landloom.operators.indexing import dense_index
from landloom.sources.geojson_ranges import collection_features

GEOMETRY_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
PLUGIN_TYPES = ("Point", "LineString", "Polygon", "MultiPolygon")

_D1 = T.ArrayType(T.DoubleType())
_D2, _D3, _D4 = T.ArrayType(_D1), T.ArrayType(T.ArrayType(_D1)), T.ArrayType(T.ArrayType(T.ArrayType(_D1)))

_GEOMETRY_TEXT = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])
_FEATURE_TEXT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("geometry", T.StringType()),
    ]
)
_ROOT_TEXT = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(T.StringType()))]
)


def _positions(raw: Column) -> Column:
    """Positions with at least two numbers, further dimensions ignored."""
    usable = F.filter(raw, lambda p: (F.size(p) >= 2))
    return F.transform(usable, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def _rings(geom_type: Column, text: Column) -> Column:
    """All parts of a geometry as an array of rings."""
    as1, as2, as3, as4 = (F.from_json(text, t) for t in (_D1, _D2, _D3, _D4))
    return (
        F.when(geom_type == "Point", F.array(_positions(F.array(as1))))
        .when(geom_type.isin("MultiPoint", "LineString"), F.array(_positions(as2)))
        .when(geom_type.isin("MultiLineString", "Polygon"), F.transform(as3, _positions))
        .when(geom_type == "MultiPolygon", F.flatten(F.transform(as4, lambda poly: F.transform(poly, _positions))))
    )


def _ring_is_outer(geom_type: Column, text: Column, rings: Column) -> Column:
    first_only = F.transform(rings, lambda _, i: i == 0)
    per_polygon = F.flatten(
        F.transform(F.from_json(text, _D4), lambda poly: F.transform(poly, lambda _, i: i == 0))
    )
    return (
        F.when(geom_type == "Polygon", first_only)
        .when(geom_type == "MultiPolygon", per_polygon)
        .otherwise(F.transform(rings, lambda _: F.lit(True)))
    )


def _flat_coords(geom_type: Column, rings: Column) -> Column:
    """The one vertex list the analysis works on.

    Points and lines as they are, an area by its first outer ring, and the
    remaining multi-part kinds with all their vertices.
    """
    return F.when(geom_type.isin("Polygon", "MultiPolygon"), rings[0]).otherwise(F.flatten(rings))


def property_map(text: Column) -> Column:
    """Scalar properties as strings; null and nested values are dropped.

    The JSON type decides, so a string that begins with a bracket stays.
    """
    raw = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    typed = F.from_json(text, T.MapType(T.StringType(), T.VariantType()))
    nested = lambda k: F.schema_of_variant(F.element_at(typed, k)).rlike("^(OBJECT|ARRAY)<")
    scalar = F.map_filter(raw, lambda k, v: v.isNotNull() & ~(v.rlike(r"^\s*[\[{]") & nested(k)))
    return F.coalesce(scalar, F.create_map().cast("map<string,string>"))


def parse_features(features: DataFrame, text_col: str = "feature", parity: str = "tiler") -> DataFrame:
    """Parse one GeoJSON Feature per row.

    Adds ``geom_type, category, coords, rings, ring_is_outer, props``; rows
    without a usable geometry are dropped. ``parity='plugin'`` accepts only
    Point, LineString, Polygon and MultiPolygon.
    """
    accepted = {"tiler": GEOMETRY_TYPES, "plugin": PLUGIN_TYPES}[parity]
    keep = [c for c in features.columns if c != text_col]
    outer = features.select(*keep, F.from_json(text_col, _FEATURE_TEXT).alias("_f")).where("_f.geometry IS NOT NULL")
    geom = outer.select(
        *keep,
        F.from_json("_f.geometry", _GEOMETRY_TEXT).alias("_g"),
        F.col("_f.properties").alias("_p"),
    ).where(F.col("_g.type").isin(*accepted) & F.col("_g.coordinates").isNotNull())
    kind, text = F.col("geom_type"), F.col("_text")
    parsed = geom.select(
        *keep, F.col("_g.type").alias("geom_type"), F.col("_g.coordinates").alias("_text"), property_map(F.col("_p")).alias("props")
    ).withColumn("rings", _rings(kind, text))
    parsed = parsed.withColumn("ring_is_outer", _ring_is_outer(kind, text, F.col("rings")))
    return (
        parsed.withColumn("coords", _flat_coords(kind, F.col("rings")))
        .where(F.size("coords") > 0)
        .select(
            *keep,
            "geom_type",
            K.infer_category(F.col("props")).alias("category"),
            "coords",
            "rings",
            "ring_is_outer",
            "props",
        )
    )


def explode_collections(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Rows of whole documents to rows of features, with their position.

    A FeatureCollection yields its features, a single Feature itself, any
    other root nothing.
    """
    keep = [c for c in docs.columns if c != text_col]
    root = F.from_json(text_col, _ROOT_TEXT)
    body = (
        F.when(root["type"] == "FeatureCollection", root["features"])
        .when(root["type"] == "Feature", F.array(F.col(text_col)))
    )
    return docs.select(*keep, F.posexplode(body).alias("pos", "feature"))


def read_geojson(spark: SparkSession, paths: str | list[str], parity: str = "tiler", with_ids: bool = True) -> DataFrame:
    """Features of GeoJSON files, with ``feature_id`` in file and row order.

    Ids are 0-based over all files in path order and are given to every
    feature that has a geometry, before any other check. Files are read in byte
    ranges (``geojson_ranges``), so a collection of any size is many tasks.
    """
    rows = collection_features(spark, paths)
    if with_ids:
        rows = _has_geometry(rows)
        rows = dense_index(rows, [F.col("source"), F.col("split")], [F.col("no")], "feature_id")
    return parse_features(rows.drop("split", "no"), parity=parity)


def read_geojson_lines(spark: SparkSession, paths: str | list[str], parity: str = "tiler", with_ids: bool = True) -> DataFrame:
    """Features of newline-delimited GeoJSON (splittable)."""
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("feature"),
    )
    if with_ids:
        rows = _has_geometry(rows)
        rows = dense_index(rows, [F.col("source"), F.col("_split")], [F.col("pos")], "feature_id")
    return parse_features(rows.drop("pos", "_split"), parity=parity)


def _has_geometry(rows: DataFrame) -> DataFrame:
    return rows.where(F.get_json_object("feature", "$.geometry").isNotNull())


def source_feature_id(props: Column, keys: tuple[str, ...] = ("feature_id",)) -> Column:
    """Id a tiling run stored in the properties under one of ``keys``, the first that is there."""
    return F.coalesce(*[F.element_at(props, k).try_cast("double").cast("long") for k in keys])


def source_clipped(props: Column, keys: tuple[str, ...] = ("clipped",)) -> Column:
    """Tile-crossing flag stored in the properties under one of ``keys``."""
    return F.coalesce(*[F.element_at(props, k) == "true" for k in keys], F.lit(False))


def feature_text(geom_type: Column, coordinates_json: Column, props: Column) -> Column:
    """GeoJSON text of a feature (export side)."""
    return F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json(props),
        F.lit(',"geometry":{"type":"'),
        geom_type,
        F.lit('","coordinates":'),
        coordinates_json,
        F.lit("}}"),
    )


def coordinates_text(geom_type: Column, rings: Column, ring_is_outer: Column) -> Column:
    """Coordinates member of a feature from its rings."""
    pair = lambda p: F.array(p["lon"], p["lat"])
    nested = F.transform(rings, lambda r: F.transform(r, pair))
    polygon_no = F.transform(
        rings, lambda _, i: F.size(F.filter(F.slice(ring_is_outer, F.lit(1), i + 1), lambda o: o))
    )
    grouped = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.array_max(polygon_no))),
        lambda k: F.transform(
            F.filter(F.arrays_zip(nested.alias("r"), polygon_no.alias("n")), lambda z: z["n"] == k), lambda z: z["r"]
        ),
    )
    return (
        F.when(geom_type == "Point", F.to_json(nested[0][0]))
        .when(geom_type.isin("MultiPoint", "LineString"), F.to_json(nested[0]))
        .when(geom_type.isin("MultiLineString", "Polygon"), F.to_json(nested))
        .otherwise(F.to_json(grouped))
    )
