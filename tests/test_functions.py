import math

import pytest
from pyspark.sql import functions as F

from landloom.functions import projection as P
from landloom.functions import rasters as R

CITIES = [
    ("Shanghai", 121.4737, 31.2304, 51, 354633.6490, 3456140.5297, 0.0232),
    ("Tokyo", 139.6917, 35.6895, 54, 381622.2300, 3950298.9080, 0.0398),
    ("London", -0.1278, 51.5074, 30, 699316.2343, 5710163.7585, 0.1354),
    ("New York", -74.0060, 40.7128, 18, 583959.3723, 4507350.9984, 0.0652),
    ("Sydney", 151.2093, -33.8688, 56, 334368.6336, 6250948.3453, -0.0323),
    ("zero", 0.0, 0.0, 31, 166021.4432, 0.0, 0.0),
    ("pole", 15.0, 89.0, 33, 500000.0, 9886315.7559, 0.0691),
]


def test_utm_forward_and_back(spark):
    df = spark.createDataFrame([c[:3] for c in CITIES], "name string, lon double, lat double")
    df = df.withColumns(
        {"u": P.wgs84_to_utm(F.col("lon"), F.col("lat")), "s": P.wgs84_to_utm(F.col("lon"), F.col("lat"), series="short")}
    ).cache()
    back = P.utm_to_wgs84(F.col("u.easting"), F.col("u.northing"), F.col("u.zone"), F.col("u.north"))
    rows = {r["name"]: r for r in df.withColumn("b", back).collect()}
    for name, lon, lat, zone, e, n, gap in CITIES:
        r = rows[name]
        assert r["u"]["zone"] == zone
        assert r["u"]["easting"] == pytest.approx(e, abs=1e-3)
        assert r["u"]["northing"] == pytest.approx(n, abs=1e-3)
        assert r["s"]["northing"] - r["u"]["northing"] == pytest.approx(gap, abs=1e-3)
        assert r["b"]["lon"] == pytest.approx(lon, abs=1e-7) and r["b"]["lat"] == pytest.approx(lat, abs=1e-6)


def test_staged_projection_equals_expression(spark):
    df = spark.createDataFrame([(121.47, 31.23), (123.9, 30.0)], "lon double, lat double")
    staged = P.with_utm(df, {"p": ("lon", "lat")}, 51, True)
    r = staged.withColumn("u", P.wgs84_to_utm(F.col("lon"), F.col("lat"), 51)).collect()
    for row in r:
        assert row["p_e"] == pytest.approx(row["u"]["easting"], abs=1e-8)
        assert row["p_n"] == pytest.approx(row["u"]["northing"], abs=1e-8)


def test_grid_origin_lies_in_tile_zero(spark):
    df = spark.createDataFrame([(121.47, 31.23)], "lon double, lat double")
    r = P.with_tiles(df, {"t": ("lon", "lat")}, 500.0, 121.47, 31.23).first()
    assert (r["t_col"], r["t_row"]) == (0, 0)


def test_local_frame_and_distance(spark):
    r = spark.range(1).select(
        P.geo_to_world(121.4955, 31.2397, 121.495, 31.240).alias("w"),
        P.haversine_m(121.4737, 31.2304, 139.6917, 35.6895).alias("d"),
    ).first()
    assert r["w"]["x"] == pytest.approx(4753.5965, abs=1e-3)
    assert r["w"]["y"] == pytest.approx(-3335.8478, abs=1e-3)
    assert r["d"] == pytest.approx(1758219.218, abs=0.01)


def test_names(spark):
    names = ["UTM51N", "UTM7S", "UTM51N (EPSG:32651)", "WGS84"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", P.parse_projection(F.col("n")).alias("p"))
    got = {r["n"]: (r["p"]["zone"], r["p"]["north"]) for r in df.collect()}
    assert got == {"UTM51N": (51, True), "UTM7S": (7, False), "UTM51N (EPSG:32651)": (51, True), "WGS84": (0, True)}
    tiles = ["N31E121", "S12W077", "X31E121", "N31"]
    b = spark.createDataFrame([(n,) for n in tiles], "n string").select("n", R.srtm_bounds(F.col("n")).alias("b"))
    got = {r["n"]: tuple(r["b"]) if r["b"] else None for r in b.collect()}
    assert got["N31E121"] == (121.0, 31.0, 122.0, 32.0)
    assert got["S12W077"] == (-77.0, -12.0, -76.0, -11.0)
    assert got["X31E121"] is None and got["N31"] is None
    assert math.isclose(P.meters_per_degree_lat(), 111319.49, abs_tol=0.01)
