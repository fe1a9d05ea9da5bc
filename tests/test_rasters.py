import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import elevation, landcover
from landloom.sources import dem
from landloom.sources import landcover as source


def docs(spark, grids):
    return spark.createDataFrame([(c, r, json.dumps(d)) for (c, r), d in grids.items()], "tile_col int, tile_row int, value string")


def grid(classes, w=5, h=5, key="classes"):
    return {"width": w, "height": h, "cell_size_m": 10.0, key: classes}


def test_votes(spark):
    some = lambda code, n, rest: [code] * n + [rest] * (25 - n)
    cases = {
        (0, 0): (grid([10] * 25), "Forest"),
        (1, 0): (grid(some(40, 20, 10)), "Farmland"),
        (2, 0): (grid(some(80, 9, 10)), "Water"),
        (3, 0): (grid(some(80, 1, 10), key="data"), "Forest"),
        (4, 0): (grid([0] * 25), "Unknown"),
        (5, 0): (grid([50] * 12 + [30] * 12 + [0]), "Residential"),
    }
    grids, pixels = source.parse_landcover(docs(spark, {k: v[0] for k, v in cases.items()}))
    assert grids.where("valid").count() == 6
    bounds = grids.withColumns({"min_lon": F.lit(0.0), "min_lat": F.lit(0.0), "max_lon": F.lit(5.0), "max_lat": F.lit(5.0)})
    ring = [(0.1, 0.1), (4.9, 0.1), (4.9, 4.9)]
    rows = [(i, c, r, ring, "Unknown") for i, (c, r) in enumerate(cases)]
    polys = spark.createDataFrame(rows, "polygon_id long, tile_col int, tile_row int, geo_vertices array<struct<lon:double,lat:double>>, land_use string")
    got = {(r["tile_col"], r["tile_row"]): r["land_use"] for r in landcover.fuse_landcover(polys, pixels, bounds).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_row_origin_and_windows(spark):
    rows = [10] * 10 + [40] * 15
    grids, pixels = source.parse_landcover(docs(spark, {(0, 0): grid(rows)}))
    bounds = grids.withColumns({"min_lon": F.lit(0.0), "min_lat": F.lit(0.0), "max_lon": F.lit(5.0), "max_lat": F.lit(5.0)})
    polys = spark.createDataFrame([(1, 0, 0, [(0.1, 3.6), (4.9, 3.6), (4.9, 4.9)], "Unknown")],
                                  "polygon_id long, tile_col int, tile_row int, geo_vertices array<struct<lon:double,lat:double>>, land_use string")
    use = lambda o: landcover.fuse_landcover(polys, pixels, bounds, o).first()["land_use"]
    assert use("north") == "Forest" and use("south") == "Farmland"
    assert landcover.majority_class(pixels, 0, 0, 5, 2).first()["majority"] == 10
    assert landcover.majority_class(pixels, -3, 3, 99, 99).first()["majority"] == 40
    assert landcover.majority_class(pixels, 9, 9, 2, 2).first()["majority"] == 0


def test_bad_length_is_invalid(spark):
    grids, pixels = source.parse_landcover(docs(spark, {(0, 0): grid([10] * 7)}))
    assert not grids.first()["valid"] and pixels.count() == 0


def test_decoders(spark, tmp_path):
    side = 1201
    hgt = np.arange(side * side, dtype=">i4").astype(">i2").reshape(side, side)
    hgt[0, 5] = -32768
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "N31E121.hgt").write_bytes(hgt.tobytes())
    (tmp_path / "a.raw").write_bytes(np.arange(16, dtype="<u2").tobytes())
    (tmp_path / "b.tif").write_bytes(b"MM\x00\x2a" + np.arange(-6, 6, dtype=">i2").tobytes())
    (tmp_path / "bad.hgt").write_bytes(b"\x00" * 10)
    (tmp_path / "note.txt").write_text("x")
    files = dem.list_dem_files(spark, str(tmp_path))
    assert files.count() == 4
    px = dem.decode(files.where("path LIKE '%.hgt'")).cache()
    assert px.count() == side * side
    got = {(r["px"], r["py"]): r["elev"] for r in px.where("py < 2 AND px BETWEEN 4 AND 6").collect()}
    assert got[5, 0] is None and got[4, 0] == 4.0 and got[6, 1] == float(hgt[1, 6])
    assert [r["elev"] for r in dem.decode(files.where("path LIKE '%.raw'")).orderBy("py", "px").collect()] == [float(i) for i in range(16)]
    assert [r["elev"] for r in dem.decode(files.where("path LIKE '%.tif'"), 4, 3).orderBy("py", "px").collect()] == [float(i) for i in range(-6, 6)]
    bad = dem.rejects(files, 4, 3).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("bad.hgt")
    tiles, pixels = dem.read_dem(spark, str(tmp_path / "sub"))
    assert tuple(tiles.select("min_lon", "min_lat", "width").first()) == (121.0, 31.0, side)
    pts = spark.createDataFrame([(121.0, 32.0), (121.999999, 31.000001), (0.0, 0.0)], "lon double, lat double")
    vals = {r["lon"]: r["elev"] for r in elevation.sample_nearest(pts, tiles, pixels).collect()}
    assert vals[121.0] == 0.0 and vals[121.999999] == float(hgt[-1, -1]) and vals[0.0] is None


def test_grid_shape():
    assert elevation.grid_shape((121.49, 31.235, 121.50, 31.245), 30.0) == (32, 37)


def test_bilinear_falls_back_on_missing(spark):
    tiles = spark.createDataFrame([("t", 0, 0.0, 0.0, 2.0, 2.0, 2, 2)], "dem_id string, tile_ord long, min_lon double, min_lat double, max_lon double, max_lat double, width int, height int")
    full = spark.createDataFrame([("t", 0, 0, 1.0), ("t", 1, 0, 3.0), ("t", 0, 1, 5.0), ("t", 1, 1, 7.0)], "dem_id string, px int, py int, elev float")
    pts = spark.createDataFrame([(1.0, 1.0), (0.6, 1.4)], "lon double, lat double")
    got = {r["lon"]: r["elev"] for r in elevation.sample_bilinear(pts, tiles, full).collect()}
    assert got[1.0] == pytest.approx(4.0) and got[0.6] == pytest.approx(1.0 + 2 * 0.1 + 4 * 0.1)
    holes = full.where("NOT (px = 1 AND py = 1)")
    got = {r["lon"]: r["elev"] for r in elevation.sample_bilinear(pts, tiles, holes).collect()}
    assert got[0.6] == 1.0
