import json
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from landloom.operators import roads
from landloom.operators.classify import assign_parameters, classify
from landloom.plans import derive as D
from landloom.plans.region import generate_region
from landloom.schema import ClassifyRules
from landloom.sinks import store
from landloom.sources import arcgis
from landloom.streaming import tile_reads


def lines(spark, coords, cls="primary"):
    rows = [(i, [(float(a), float(b)) for a, b in c], {"highway": cls} if cls else {}) for i, c in enumerate(coords)]
    return spark.createDataFrame(rows, "feature_id long, coords array<struct<lon:double,lat:double>>, props map<string,string>")


def test_crossing_roads_split(spark):
    n, e = roads.build_graph(lines(spark, [[(0, 0), (0.1, 0.1)], [(0, 0.1), (0.1, 0)]]))
    assert n.count() == 4 and e.count() == 2
    n, e = roads.split_at_crossings(n, e)
    assert n.count() == 5 and e.count() == 4
    turns = {(r["edge_id"], r["forward"]): r["next_edge_id"] for r in roads.leftmost_turns(n, e).collect()}
    assert len(turns) == 4 and len(set(turns.values())) == 4


def test_no_split_and_merged_vertices(spark):
    n, e = roads.build_graph(lines(spark, [[(0, 0), (0.1, 0.1)], [(0, 0), (0.1, 0)], [(0, 0.5), (0.1, 0.5)]], cls=None))
    assert {r["road_class"] for r in e.collect()} == {"unclassified"}
    assert roads.split_at_crossings(n, e)[1].count() == 3
    n, e = roads.build_graph(lines(spark, [[(0, 0), (0.0005, 0), (0.2, 0)]]))
    assert n.count() == 2 and e.count() == 1


@pytest.mark.parametrize("block", [128, 1])
def test_first_come_merging(spark, block):
    rng = np.random.default_rng(5)
    x, y = np.r_[rng.uniform(0, 500, 20), np.full(6, 33.0)], np.r_[rng.uniform(0, 200, 20), np.full(6, 44.0)]
    df = pd.DataFrame({"x": x, "y": y, "ord": rng.permutation(26)})
    got = roads.merge_positions(spark.createDataFrame(df), 100.0, block).toPandas().set_index("ord").leader.to_dict()
    want, leads = {}, []
    for r in df.sort_values("ord").itertuples():
        near = [(np.hypot(a - r.x, b - r.y), o) for a, b, o in leads]
        near = [q for q in near if q[0] < 100.0]
        if near:
            want[r.ord] = min(near)[1]
        else:
            leads.append((r.x, r.y, r.ord))
            want[r.ord] = r.ord
    assert got == want


def test_feature_service_pages(spark):
    def fetch(url):
        assert "where=a%20%3D%201" in url and "geometry=1.000000,2.000000,3.000000,4.000000" in url
        if "bad" in url:
            raise OSError("down")
        start = int(url.split("resultOffset=")[1].split("&")[0]) if "resultOffset" in url else 0
        n = 2 if start < 4 else 1
        feats = [{"type": "Feature", "properties": {"n": start + i}, "geometry": {"type": "Point", "coordinates": [start + i, 0]}} for i in range(n)]
        return json.dumps({"type": "FeatureCollection", "features": feats})

    arcgis.register(spark, fetch)
    df = arcgis.read_arcgis(spark, "http://h/0", ["http://h/1", "http://bad/2"], where="a = 1", bounds=(1, 2, 3, 4), max_record_count=2, partial="keep")
    assert sorted((r["feature_id"], r["props"]["n"]) for r in df.collect()) == [(i, str(i % 5)) for i in range(10)]
    with pytest.raises(Exception, match="down"):
        arcgis.read_arcgis(spark, "http://h/0", ["http://bad/2"], where="a = 1", bounds=(1, 2, 3, 4)).collect()
    assert sorted(r["props"]["n"] for r in df.collect()) == sorted(["0", "1", "2", "3", "4"] * 2)
    url = arcgis.query_url("http://h/0", "1=1", "*", 5)
    assert url == "http://h/0/query?where=1%3D1&outFields=%2A&f=geojson&resultRecordCount=5"


def test_filters_reach_the_feature_service(spark, tmp_path):
    log = str(tmp_path / "asked")

    def fetch(url):
        asked = unquote(url.split("where=")[1].split("&")[0])
        with open(log, "a") as f:
            f.write(asked + "\n")
        if "returnCountOnly" in url:
            raise OSError("no counts")
        # The server knows one condition, and compares without case.
        rows = [("Elm", 3), ("elm", 9), ("Oak", 12), ("O'Hara", 4), (None, 7)]
        kept = [r for r in rows if "pop > 3" not in asked or r[1] > 3]
        return json.dumps({"features": [{"type": "Feature", "properties": {"name": n, "pop": p}, "geometry": {"type": "Point", "coordinates": [p, 0]}} for n, p in kept]})

    arcgis.register(spark, fetch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        only = (F.col("pop") > 3) & F.col("name").isin("elm", "O'Hara") & (F.length("name") > 1)
        df = arcgis.read_arcgis(spark, "http://h/0", where="a = 1", fields="name string, pop long", only=only)
        assert sorted((r["feature_id"], r["props"]["name"]) for r in df.collect()) == [(0, "elm"), (1, "O'Hara")]
        asked = set(open(log).read().splitlines())
        assert all(a.startswith("(a = 1) AND ") and "pop > 3" in a and "name IN ('elm', 'O''Hara')" in a for a in asked if "pop" in a) and any("pop" in a for a in asked)
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    rows = spark.read.format("arcgis_features").option("url", "http://h/0").option("fields", "name string, pop double").option("push_filters", "false").load()
    assert sorted(r["pop"] for r in rows.where("name IS NULL OR pop > 8").collect()) == [7.0, 9.0, 12.0]


def test_conditions_for_the_server():
    names = {"a", "b"}
    say = lambda f: arcgis.condition(f, names)
    assert say(ds.EqualTo(("a",), "it's")) == "a = 'it''s'" and say(ds.LessThanOrEqual(("b",), 2.5)) == "b <= 2.5"
    assert say(ds.Not(ds.In(("a",), (1, 2)))) == "NOT (a IN (1, 2))" and say(ds.IsNull(("a",))) == "a IS NULL"
    assert say(ds.StringStartsWith(("a",), "ab")) == "a LIKE 'ab%'" and say(ds.StringContains(("a",), "5%")) is None
    assert say(ds.EqualTo(("c",), 1)) is None and say(ds.EqualTo(("a",), True)) is None and say(ds.EqualTo(("a", "x"), 1)) is None
    assert say(ds.Not(ds.EqualTo(("a",), "x"))) is None and say(ds.LessThan(("a",), "x")) is None
    assert say(ds.Not(ds.IsNull(("a",)))) is None and say(ds.GreaterThan(("a",), float("inf"))) is None


def test_region_store_and_tile_reads(spark, tmp_path):
    def box(lon, lat, s):
        return [[[lon, lat], [lon + s, lat], [lon + s, lat + s], [lon, lat + s], [lon, lat]]]

    feats = [
        {"type": "Feature", "properties": {"building": "yes"}, "geometry": {"type": "Polygon", "coordinates": box(0.0, 0.0, 0.001)}},
        {"type": "Feature", "properties": {"natural": "water"}, "geometry": {"type": "Polygon", "coordinates": box(0.01, 0.01, 0.004)}},
        {"type": "Feature", "properties": {"landuse": "farm"}, "geometry": {"type": "Polygon", "coordinates": box(0.011, 0.011, 0.001)}},
        {"type": "Feature", "properties": {"highway": "trunk"}, "geometry": {"type": "LineString", "coordinates": [[0.0005, 0.0012], [0.5, 0.5]]}},
    ]
    path = tmp_path / "f.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    polygons, report = generate_region(spark, "local", str(path), 0.0, 0.0)
    got = {r["polygon_id"]: (r["land_use"], r["adjacent_main_road"]) for r in polygons.collect()}
    assert got == {0: ("Residential", True), 1: ("Water", False), 2: ("Water", False)}
    assert sum(r["polygon_count"] for r in report.collect()) == 3
    rules = ClassifyRules(building_density={"Commercial": 0.7})
    ruled = {r["polygon_id"]: (r["land_use"], r["building_density"], r["building_setback"]) for r in assign_parameters(classify(polygons, rules), rules).collect()}
    assert ruled[0] == ("Commercial", 0.7, 10.0) and ruled[1] == ("Farmland", 0.0, 5.0)
    assert classify(polygons, rules, keep_water=True).where("land_use = 'Water'").count() == 2

    tiled = polygons.selectExpr("*", "CAST(floor(center_x / 50000) AS INT) tile_col", "CAST(floor(center_y / 50000) AS INT) tile_row")
    store.write_store(tiled, str(tmp_path / "store"))
    near = tile_reads.read_around(spark, str(tmp_path / "store"), 5000.0, 5000.0, 500.0, 1)
    assert [r["polygon_id"] for r in near.collect()] == [0]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tile_col" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert generate_region(spark, "store", str(tmp_path / "store"))[1].count() == 2


def test_terrain_derivation_covers_the_area(spark):
    tiles = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.01, 0.01, 40, 40)], "dem_id string, tile_ord long, min_lon double, min_lat double, max_lon double, max_lat double, width int, height int")
    pixels = spark.range(1600).selectExpr("'t' dem_id", "CAST(id % 40 AS INT) px", "CAST(floor(id / 40) AS INT) py", "CAST(IF(id % 40 < 20, 10, 400) AS FLOAT) elev")
    road = lines(spark, [[(-0.001, 0.005), (0.011, 0.005)]]).selectExpr("*", "'LineString' geom_type", "'Road' category")
    cut = D.derive(spark, road, 0.0, 0.0, None, (tiles, pixels), (0.0, 0.0, 0.01, 0.01))
    whole = D.derive(spark, road.withColumn("category", F.lit("Other")), 0.0, 0.0, None, (tiles, pixels), (0.0, 0.0, 0.01, 0.01))
    a, b = cut.agg(F.sum("area_sqm"), F.count(F.lit(1))).first(), whole.agg(F.sum("area_sqm"), F.count(F.lit(1))).first()
    assert a[0] == pytest.approx(b[0], rel=1e-6) and a[1] > b[1]
    side = 0.01 * np.pi / 180 * 6371000
    assert b[0] == pytest.approx(side * side, rel=1e-3)
