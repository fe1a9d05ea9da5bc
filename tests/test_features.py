import json

import pytest

from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.operators import filters as Fl
from landloom.operators import tiling
from landloom.operators import validate as val
from landloom.plans import tiled
from landloom.plans.region import generate_region
from landloom.sinks import tiles as sink
from landloom.sources import discovery, geojson, manifest
from landloom.sources.provider import TiledFiles

SQ = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 0.0]]
HOLE = [[0.5, 0.5], [1.0, 0.5], [1.0, 1.0], [0.5, 0.5]]
KINDS = [
    ("Point", [1.0, 2.0, 9.0]),
    ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]]),
    ("LineString", [[1.0, 2.0], [3.0], [3.0, 4.0]]),
    ("MultiLineString", [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 3.0]]]),
    ("Polygon", [SQ, HOLE]),
    ("MultiPolygon", [[SQ, HOLE], [[[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]]]]),
    ("GeometryCollection", []),
]


def feature(kind, coords, **props):
    return {"type": "Feature", "properties": props, "geometry": {"type": kind, "coordinates": coords}}


def parsed(spark, features, **kw):
    df = spark.createDataFrame([(i, json.dumps(f)) for i, f in enumerate(features)], "i int, feature string")
    return {r["i"]: r for r in geojson.parse_features(df, **kw).collect()}


def test_geometry_kinds(spark):
    rows = parsed(spark, [feature(k, c) for k, c in KINDS] + [{"type": "Feature", "geometry": None}])
    sizes = {i: len(r["coords"]) for i, r in rows.items()}
    assert sizes == {0: 1, 1: 2, 2: 2, 3: 4, 4: 4, 5: 4}
    assert rows[5]["ring_is_outer"] == [True, False, True]
    narrow = parsed(spark, [feature(k, c) for k, c in KINDS], parity="plugin")
    assert set(narrow) == {0, 2, 4, 5}


def test_properties_are_scalar_strings(spark):
    f = feature("Point", [1.0, 2.0], a="x", n=3, b=True, gone=None, deep={"k": 1}, arr=[1])
    assert parsed(spark, [f])[0]["props"] == {"a": "x", "n": "3", "b": "true"}
    bare = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}
    assert parsed(spark, [bare])[0]["props"] == {}


def test_centroid_and_bbox(spark):
    df = spark.createDataFrame([(json.dumps(feature(*KINDS[5])),)], "feature string")
    r = geojson.parse_features(df).select(
        G.feature_centroid(F.col("geom_type"), F.col("rings"), F.col("ring_is_outer")).alias("c"), G.feature_bbox(F.col("rings")).alias("b")
    ).first()
    assert abs(r["c"]["lon"] - (0 + 2 + 2 + 0 + 5 + 6 + 6) / 7) < 1e-12
    assert tuple(r["b"]) == (0.0, 0.0, 6.0, 6.0)


def test_ids_follow_file_and_row_order(spark, tmp_path):
    for name, base in (("a", 0), ("b", 10)):
        feats = [feature("Point", [float(base + i), 1.0], n=base + i) for i in range(3)]
        feats.insert(1, {"type": "Feature", "properties": {}, "geometry": None})
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps(f) for f in feats))
    for read, ext in ((geojson.read_geojson, "geojson"), (geojson.read_geojson_lines, "jsonl")):
        rows = read(spark, [str(tmp_path / f"{n}.{ext}") for n in "ab"]).collect()
        assert sorted((r["feature_id"], r["props"]["n"]) for r in rows) == list(enumerate(["0", "1", "2", "10", "11", "12"]))


def test_source_ids_by_exact_key(spark):
    df = spark.createDataFrame([({"x_feature_id": "7", "x_clipped": "true"},), ({"feature_id": "8", "parent_feature_id": "9"},), ({"feature_id": "no"},)], "props map<string,string>")
    rows = df.select(geojson.source_feature_id(F.col("props")).alias("i"), geojson.source_clipped(F.col("props")).alias("c")).collect()
    assert [(r["i"], r["c"]) for r in rows] == [(None, False), (8, False), (None, False)]
    keys = ("feature_id", "x_feature_id")
    rows = df.select(geojson.source_feature_id(F.col("props"), keys).alias("i"), geojson.source_clipped(F.col("props"), ("x_clipped",)).alias("c")).collect()
    assert [(r["i"], r["c"]) for r in rows] == [(7, True), (8, False), (None, False)]


def test_bracketed_strings_stay(spark):
    f = feature("Point", [1.0, 2.0], name="[old] inn", memo="{x}", deep={"a": 1}, more=[1], gone=None)
    props = geojson.parse_features(spark.createDataFrame([(json.dumps(f),)], "feature string")).first()["props"]
    assert props == {"name": "[old] inn", "memo": "{x}"}


def square(lon, lat, size, **props):
    ring = [[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size], [lon, lat]]
    return feature("Polygon", [ring], **props)


def test_preprocess_end_to_end(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    (src / "dem").mkdir(parents=True)
    feats = [square(121.4702 + i * 0.006, 31.2302 + j * 0.005, 0.0005, building="yes") for i in range(2) for j in range(2) for _ in range(1 + i + j)]
    feats.append(feature("LineString", [[121.4705, 31.2305], [121.4795, 31.2305]], highway="primary"))
    (src / "area.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (src / "ESA_WorldCover_x.tif").write_bytes(b"II")
    (src / "dem" / "N31E121.hgt").write_bytes(b"\x00\x01" * 1201 * 1201)
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in discovery.discover_inputs(spark, str(src)).collect()}
    assert kinds == {"area.geojson": "geojson", "ESA_WorldCover_x.tif": "landcover", "N31E121.hgt": "dem"}

    grid = tiling.Grid(500.0, 121.47, 31.23)
    issues = tiled.preprocess(spark, str(src), str(out), grid, skip_dem=True, placeholder_landcover=True)
    assert issues.count() == 0
    head, tiles = manifest.read_tile_manifest(spark, str(out / "manifest"))
    assert head.first()["zone"] == 51 and head.first()["num_tiles"] == tiles.count() >= 4
    stored = spark.read.parquet(str(out / "features"))
    assert stored.select("feature_id").distinct().count() == len(feats)
    assert stored.where("clipped").select("feature_id").distinct().count() >= 1
    assert tiling.first_copies(stored.withColumn("tile_ord", F.struct("tile_col", "tile_row"))).count() == len(feats)
    actual = stored.groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("actual_count"))
    one = tiles.select("tile_col", "tile_row").first()
    lost = val.tile_issues(tiles, actual.where(f"NOT (tile_col = {one[0]} AND tile_row = {one[1]})"))
    assert [(r["tile_col"], r["tile_row"], r["rule"]) for r in lost.collect()] == [(one[0], one[1], "geojson_missing")]
    provider = TiledFiles(spark, str(out / "manifest"))
    once = provider.features().collect()
    assert sorted(r["feature_id"] for r in once) == list(range(len(feats)))
    assert provider.features((121.4701, 31.2301, 121.4712, 31.2312)).count() >= 1
    grids, pixels = provider.landcover()
    assert grids.count() == tiles.count() and pixels.count() == 100 * tiles.count()
    near = (121.4701, 31.2301, 121.4712, 31.2312)
    wanted = Fl.tiles_in_bounds(tiles, near).count()
    docs = provider._documents(Fl.tiles_in_bounds(tiles, near), "landcover", "*", True)
    assert sum("/landcover/" in f for f in docs.inputFiles()) == wanted < tiles.count() and provider.landcover(near)[1].count() == 100 * wanted
    polygons, _ = generate_region(spark, "tiled", str(out / "manifest"), 121.47, 31.23)
    assert polygons.count() == len(feats) - 1
    gone = out / "features" / f"tile_col={one[0]}" / f"tile_row={one[1]}"
    gone.rename(tmp_path / "moved")
    assert [(r["tile_col"], r["tile_row"], r["rule"]) for r in tiled.validate_output(spark, str(out)).collect()] == [(one[0], one[1], "geojson_missing")]
    with pytest.raises(FileNotFoundError):
        TiledFiles(spark, str(out / "manifest")).features()
    (tmp_path / "moved").rename(gone)
    sink.write_tile_lines(stored, str(out / "lines"))
    again = geojson.read_geojson_lines(spark, str(out / "lines"), with_ids=False)
    assert again.count() == stored.count()


def test_empty_manifest_is_not_written(spark, tmp_path):
    schema = "tile_col int, tile_row int, feature_count long, geojson string, dem string, landcover string, min_lon double, min_lat double, max_lon double, max_lat double"
    assert not sink.write_manifest(spark.createDataFrame([], schema), tiling.Grid(1.0, 0.0, 0.0), str(tmp_path / "m"))


def test_manifest_spellings_and_issues(spark):
    doc = {"projection": "UTM51S", "origin_lon": 1.0, "origin_lat": 2.0, "tile_size_m": 5, "tiles": [{"col": 3, "row": 4, "polygon_count": 2}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("not json",)], "value string")
    head, tiles = manifest.parse_manifest(df)
    assert (head.first()["zone"], head.first()["north"]) == (51, False)
    assert tuple(tiles.select("tile_col", "tile_row", "feature_count", "geojson").first()) == (3, 4, 2, "")
    bad = spark.createDataFrame([("{\"projection\": \"UTM1N\", \"tiles\": []}",), ("not json",)], "value string")
    rules = sorted(r["rule"] for r in val.manifest_issues(bad).collect())
    assert rules == ["manifest_json", "missing_field", "missing_field", "missing_field", "no_tiles"]


def test_many_tiles_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "FOLDERS", 2, raising=False)
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    feats = [square(121.4702 + i * 0.006, 31.2302 + j * 0.005, 0.0005, building="yes") for i in range(2) for j in range(3)]
    (src / "area.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    grid = tiling.Grid(500.0, 121.47, 31.23)
    assert tiled.preprocess(spark, str(src), str(out), grid, skip_dem=True, placeholder_landcover=True).count() == 0
    for kind in ("features", "landcover"):
        assert not list((out / kind).glob("*/tile_row=*")) and list((out / kind).glob("tile_col=*"))
    provider = TiledFiles(spark, str(out / "manifest"))
    assert sorted(r["feature_id"] for r in provider.features().collect()) == list(range(len(feats)))
    tiles, near = provider.tiles(), (121.4701, 31.2301, 121.4712, 31.2312)
    wanted = Fl.tiles_in_bounds(tiles, near).count()
    assert wanted < tiles.count() and provider.landcover(near)[1].count() == 100 * wanted and provider.features(near).count() == 1
    assert provider.landcover()[1].count() == 100 * tiles.count()
    col = tiles.first()["tile_col"]
    for kind in ("features", "landcover"):
        (out / kind / f"tile_col={col}").rename(tmp_path / kind)
    lost = tiles.where(f"tile_col = {col}").count()
    rules = [r["rule"] for r in tiled.validate_output(spark, str(out)).collect()]
    assert rules.count("geojson_missing") == rules.count("landcover_missing") == lost > 0
    for read in (provider.features, provider.landcover):
        with pytest.raises(FileNotFoundError):
            read()
