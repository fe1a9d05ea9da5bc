import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import sampling

RING = "array<struct<x:double,y:double>>"
SHAPES = [
    ([(0, 0), (5000, 0), (5000, 5000), (2500, 1200), (0, 5000)], []),
    ([(0, 0), (6000, 100), (6100, 6000), (-50, 5900)], [[(1500, 1500), (1500, 4500), (4500, 4500), (4500, 1500)], [(300, 300), (700, 900), (900, 300)]]),
    ([(100, 100), (400, 100), (400, 400)], []),
]


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [ring[-1], *ring[:-1]]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


@pytest.mark.parametrize("reach", [0.0, 120.0])
def test_points_inside_any_shape(spark, reach):
    rows = [(i, [tuple(map(float, p)) for p in ring], [[tuple(map(float, p)) for p in h] for h in holes]) for i, (ring, holes) in enumerate(SHAPES)]
    df = spark.createDataFrame(rows, f"polygon_id long, world_vertices {RING}, world_holes array<{RING}>")
    got = {(r.polygon_id, r.ix, r.iy): (r.x, r.y) for r in sampling.lattice_points(df, 250.0, reach).collect()}
    lattice = df.select("polygon_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long"))).alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(26).cast("long"))))
    moves = [sampling._jitter(42, axis, reach) if reach else F.lit(0.0) for axis in "xy"]
    want = {}
    for r in lattice.withColumns({"dx": moves[0], "dy": moves[1]}).collect():
        ring, holes = SHAPES[r.polygon_id]
        low, high = np.min(ring, axis=0), np.max(ring, axis=0)
        if r.ix > (high[0] - low[0]) // 250 or r.iy > (high[1] - low[1]) // 250:
            continue
        x, y = float(low[0]) + r.ix * 250.0 + r.dx, float(low[1]) + r.iy * 250.0 + r.dy
        if inside(x, y, [ring, *holes]):
            want[r.polygon_id, r.ix, r.iy] = (x, y)
    assert got == want and len({k[0] for k in want}) == 3


@pytest.mark.parametrize("reach", [0.0, 120.0])
def test_small_polygons_are_cut_in_place(spark, monkeypatch, reach):
    rows = [(i, [tuple(map(float, p)) for p in ring], [[tuple(map(float, p)) for p in h] for h in holes]) for i, (ring, holes) in enumerate(SHAPES)]
    df = spark.createDataFrame([*rows, (7, rows[2][1], None)], f"polygon_id long, world_vertices {RING}, world_holes array<{RING}>")
    points = sampling.lattice_points(df, 250.0, reach)
    assert "Join" not in points._jdf.queryExecution().optimizedPlan().toString()  # edges met their polygon again in a join, a broadcast by its estimate
    monkeypatch.setattr(sampling, "FEW_PLACES", 0)
    dealt = sampling.lattice_points(df, 250.0, reach)
    got = [sorted(map(tuple, p.select("polygon_id", "ix", "iy", "x", "y").collect())) for p in (points, dealt)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {0, 1, 2, 7}
