import json
import random

import pytest
from pyspark.sql import functions as F

from landloom.sources import geojson, geojson_ranges

ODD = ['plain', 'br}ace', '{"features": [', 'quo"te', "back\\slash\\", '\\"', "}}]]", "é\n日本", '"features"', ""]


def feature(n, draw):
    props = {"n": n, draw.choice(ODD): draw.choice(ODD), "list": [{"a": "}"}, {"b": [1, {"c": "]"}]}], "features": [{"x": 1}]}
    return {"type": "Feature", "properties": props, "geometry": {"type": "Point", "coordinates": [n, 0.5]}}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "1")]
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("size", [97, 700, 1 << 20])
def test_ranges_give_the_features_of_whole_files(spark, tmp_path, small_ranges, size):
    draw = random.Random(size)
    roots = [
        {"type": "FeatureCollection", "name": "a}", "crs": {"type": "name", "properties": {"features": [{"q": 1}]}}, "features": [feature(n, draw) for n in range(12)], "after": [{"z": {}}]},
        {"features": [feature(100, draw)], "type": "FeatureCollection", "late": {"features": [{"no": 1}]}},
        {"type": "FeatureCollection", "features": [], "x": {"y": {}}},
        feature(200, draw),
        {"type": "Other", "geometry": {"type": "Point"}},
    ]
    for i, root in enumerate(roots):
        (tmp_path / f"f{i}.geojson").write_text(json.dumps(root, indent=draw.choice([None, 1]), ensure_ascii=False), encoding="utf-8")
    small_ranges(size)
    rows = geojson_ranges.collection_features(spark, str(tmp_path)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.source, r.split, r.no)):
        got.setdefault(r.source[-10:-8], []).append(json.loads(r.feature))
    assert got == {"f0": roots[0]["features"], "f1": roots[1]["features"], "f3": [roots[3]]}
    if size < 1000:
        assert len({r.split for r in rows if "f0" in r.source}) > 3
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("source"), "value")
    assert geojson.explode_collections(whole).count() == len(rows)


def test_ids_follow_file_order(spark, tmp_path, small_ranges):
    root = {"type": "FeatureCollection", "features": [feature(n, random.Random(n)) | ({"geometry": None} if n == 3 else {}) for n in range(8)]}
    (tmp_path / "a.geojson").write_text(json.dumps(root))
    small_ranges(150)
    rows = geojson.read_geojson(spark, str(tmp_path / "a.geojson")).collect()
    assert sorted((r.feature_id, r.coords[0].lon) for r in rows) == list(enumerate([0.0, 1.0, 2.0, 4.0, 5.0, 6.0, 7.0]))


def test_structure_of_text():
    assert geojson_ranges.structure('{"a": "}"') == (False, 1, -1)
    assert geojson_ranges.structure('x\\"{') == (False, 1, 0)
    assert geojson_ranges.structure('[ "') == (True, 1, 0)
