"""Grid joins against brute force, on data where one spot holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from landloom.catalogue import views
from landloom.operators import spatial
from landloom.plans import derive
from landloom.session import checkpointed, measured_broadcasts


@pytest.fixture(scope="module")
def rng():
    return np.random.default_rng(7)


def clustered(rng, n, span, spot):
    return np.r_[rng.uniform(0, span, n // 2), rng.uniform(0, spot, n // 4), np.full(n - n // 2 - n // 4, spot / 3)]


def test_radius_and_nearest(spark, rng):
    n, m = 200, 500
    probes = pd.DataFrame({"id": range(n), "center_x": clustered(rng, n, 2e5, 3e3), "center_y": clustered(rng, n, 2e5, 3e3), "radius": 10 ** rng.uniform(2, 4.7, n)})
    pts = pd.DataFrame({"x": clustered(rng, m, 2e5, 3e3), "y": clustered(rng, m, 2e5, 3e3)})
    dist = np.hypot(probes.center_x.values[:, None] - pts.x.values, probes.center_y.values[:, None] - pts.y.values)
    got = spatial.flag_within_radius(spark.createDataFrame(probes), spark.createDataFrame(pts), "near").toPandas().sort_values("id")
    want = (dist < probes.radius.values[:, None]).any(axis=1)
    assert 0 < want.sum() < n
    assert (got.near.values == want).all()

    nodes = pts.reset_index(names="node_id")
    asked = probes.rename(columns={"id": "probe_id", "center_x": "x", "center_y": "y"})[["probe_id", "x", "y"]]
    found = spatial.nearest_within(spark.createDataFrame(asked), spark.createDataFrame(nodes), 4000.0).toPandas().set_index("probe_id").node_id.to_dict()
    best = {i: int(np.argmin(dist[i])) for i in range(n) if dist[i].min() < 4000.0}
    assert found == best


def inside(px, py, ring, flat):
    lons, lats = [p[0] for p in ring], [p[1] for p in ring]
    if not (min(lons) <= px <= max(lons) and min(lats) <= py <= max(lats)):
        return False
    odd = False
    for i in range(len(ring)):
        (xi, yi), (xj, yj) = ring[i], ring[i - 1]
        if abs(yj - yi) >= flat and (yi > py) != (yj > py) and px < (xj - xi) * (py - yi) / (yj - yi) + xi:
            odd = not odd
    return odd


@pytest.mark.parametrize(("limit", "flat"), [(200_000, 0.0), (40, 1e-4)])
def test_inside_any_area(spark, rng, limit, flat):
    areas = []
    for _ in range(40):
        k = int(rng.integers(3, 30))
        a = np.sort(rng.uniform(0, 2 * np.pi, k))
        rad = 10 ** rng.uniform(-3.5, -1.6) * rng.uniform(0.5, 1, k)
        cx, cy = rng.uniform(0, 0.1, 2)
        areas.append([(float(cx + r * np.cos(t)), float(cy + r * np.sin(t))) for r, t in zip(rad, a)])
    areas.append(areas[0])
    pts = pd.DataFrame({"id": range(600), "geo_lon": clustered(rng, 600, 0.1, 0.01), "geo_lat": clustered(rng, 600, 0.1, 0.01)})
    df = spark.createDataFrame([(a,) for a in areas], "coords array<struct<lon:double,lat:double>>")
    got = spatial.flag_inside_any(spark.createDataFrame(pts), df, "hit", min_edge_height=flat, pair_limit=limit).toPandas().sort_values("id")
    want = [any(inside(x, y, a, flat) for a in areas) for x, y in zip(pts.geo_lon, pts.geo_lat)]
    assert got.hit.tolist() == want


def test_crossings_with_copies_and_a_crowded_cell(spark, rng):
    n = 400
    x0, y0 = clustered(rng, n, 1000, 15) + rng.uniform(0, 5, n), clustered(rng, n, 1000, 15) + rng.uniform(0, 5, n)
    seg = pd.DataFrame({"seg_id": range(n), "n0": range(0, 2 * n, 2), "n1": range(1, 2 * n, 2), "x0": x0, "y0": y0,
                        "x1": x0 + rng.uniform(-40, 40, n), "y1": y0 + rng.uniform(-40, 40, n)})
    seg = pd.concat([seg, seg.iloc[:2].assign(seg_id=[n, n + 1])])
    got = spatial.crossing_segments(spark.createDataFrame(seg), 50.0).toPandas()
    a = seg.to_numpy()
    want = set()
    for i in range(len(a)):
        for j in range(i + 1, len(a)):
            p, q = a[i], a[j]
            if {p[1], p[2]} & {q[1], q[2]}:
                continue
            d1, d2 = (p[5] - p[3], p[6] - p[4]), (q[5] - q[3], q[6] - q[4])
            den = d1[0] * d2[1] - d1[1] * d2[0]
            if abs(den) < 1e-4:
                continue
            t = ((q[3] - p[3]) * d2[1] - (q[4] - p[4]) * d2[0]) / den
            u = ((q[3] - p[3]) * d1[1] - (q[4] - p[4]) * d1[0]) / den
            if 0.001 < t < 0.999 and 0.001 < u < 0.999:
                want.add((int(p[0]), int(q[0])))
    assert len(got) == len(want) and set(zip(got.a_id, got.b_id)) == want


def test_star_needs_no_pairs(spark):
    n = 400
    a = np.linspace(0, 2 * np.pi, n, endpoint=False)
    star = pd.DataFrame({"seg_id": range(n), "n0": 0, "n1": range(1, n + 1), "x0": 0.0, "y0": 0.0, "x1": 20 * np.cos(a), "y1": 20 * np.sin(a)})
    line = pd.DataFrame({"seg_id": [n, n + 1], "n0": [n + 1, n + 3], "n1": [n + 2, n + 4], "x0": [-30.0, 3.0], "y0": [0.5, -30.0], "x1": [30.0, 3.1], "y1": [0.5, 30.0]})
    got = spatial.crossing_segments(spark.createDataFrame(pd.concat([star, line])), 50.0).toPandas()
    rays = np.sin(a) * 20 > 0.5 / 0.999
    met = set(zip(got.a_id, got.b_id))
    assert (n, n + 1) in met and {(i, n) for i in np.flatnonzero(rays)} <= met
    assert all(i < n <= j for i, j in met - {(n, n + 1)}) and len(got) == len(met)
    assert np.allclose(got.y[(got.b_id == n)], 0.5)


def test_saved_rows_are_not_broadcast_by_a_stale_estimate(spark, tmp_path):
    """A small file's estimate outlives the expansion of its rows; such joins overfilled the driver."""
    spark.range(50).write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    many = checkpointed(few.withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(100)))))
    plan = many.where("x > 3").join(few.withColumnRenamed("id", "x"), "x")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_geometry_of_a_small_file_is_dealt_out_and_made_once(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "'PROMO' AS p_type", "1 AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    boxes = views.boxes(spark, str(tmp_path))
    sized = derive.with_world_geometry(boxes, views.LON0, views.LAT0).where("area_sqm > 0")
    assert boxes.rdd.getNumPartitions() == 2 and sized.count() == 40
    plan = sized._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform(" in line]


def test_broadcasts_by_measured_size(spark, tmp_path):
    """Rows that outgrew the estimate of their file are joined by a shuffle, small ones still by a broadcast."""
    names = ["spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    spark.range(2000).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))

    def plan(repeats):
        wide = rows.select("id", F.repeat(F.lit("x"), repeats).alias("s"))
        joined = spark.range(50_000, numPartitions=2).join(wide.groupBy("id").agg(F.max("s").alias("s")), "id")
        assert len(joined.collect()) == 2000
        return joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]

    try:
        spark.conf.set(names[0], "true")
        spark.conf.set(names[1], "300KB")
        measured_broadcasts(spark)
        for repeats, way in ((1000, "SortMergeJoin"), (1, "BroadcastHashJoin")):
            assert way in plan(repeats)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
