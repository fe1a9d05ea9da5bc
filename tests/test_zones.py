import time

import numpy as np
import pyarrow as pa
import pytest

from landloom.functions.geometry import net_area_sqm
from landloom.operators import cutting, terrain, zones
from landloom.schema import TerrainConfig


def reference_labels(c):
    h, w = c.shape
    lab, k = -np.ones(c.shape, int), 0
    for y in range(h):
        for x in range(w):
            if lab[y, x] >= 0:
                continue
            stack = [(y, x)]
            lab[y, x] = k
            while stack:
                a, b = stack.pop()
                for i, j in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                    if 0 <= i < h and 0 <= j < w and lab[i, j] < 0 and c[i, j] == c[y, x]:
                        lab[i, j] = k
                        stack.append((i, j))
            k += 1
    return lab, k


def reference_merge(lab, k, smallest):
    lab, (h, w) = lab.copy(), lab.shape
    n = np.bincount(lab.ravel(), minlength=k)
    changed = True
    while changed:
        changed = False
        for z in range(k):
            if n[z] >= smallest or n[z] == 0:
                continue
            met = {}
            for y, x in zip(*np.nonzero(lab == z)):
                for i, j in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                    if 0 <= i < h and 0 <= j < w and lab[i, j] != z:
                        met[lab[i, j]] = met.get(lab[i, j], 0) + 1
            if not met:
                continue
            best = max(met, key=lambda v: met[v])
            lab[lab == z] = best
            n[best] += n[z]
            n[z] = 0
            changed = True
    return lab


def to_grid(pdf, g, shape):
    out = np.zeros(shape, int)
    q = pdf[pdf.grid_id == g]
    out[q.y, q.x] = q.zone_id
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    shape = (8, 11)
    grids = {"g0": rng.integers(0, 2, shape), "g1": rng.integers(0, 3, shape)}
    rows = [(g, x, y, int(c[y, x]), float(x + y), 1.0) for g, c in grids.items() for y in range(shape[0]) for x in range(shape[1])]
    df = spark.createDataFrame(rows, "grid_id string, x int, y int, terrain_class int, elev double, slope double")
    return grids, shape, zones.label_zones(df, block=4).cache()


def test_labels_cross_block_seams(case):
    grids, shape, labelled = case
    pdf = labelled.toPandas()
    for g, c in grids.items():
        assert (to_grid(pdf, g, shape) == reference_labels(c)[0]).all()


def test_merging_small_zones(case):
    grids, shape, labelled = case
    cfg = TerrainConfig(resolution_m=1.0, min_zone_area_sqm=5.0)
    pdf = zones.merged_cells(labelled, cfg).toPandas()
    for g, c in grids.items():
        lab, k = reference_labels(c)
        assert (to_grid(pdf, g, shape) == reference_merge(lab, k, 5.0)).all()


def test_merging_in_rounds_equals_replay(spark):
    size = [("g", i, n) for i, n in enumerate((2, 1, 3, 2, 1, 40))]
    links = {(0, 1): 2, (0, 5): 1, (1, 2): 2, (1, 3): 1, (2, 3): 1, (3, 4): 2, (2, 5): 1, (4, 5): 1}
    rows = [("g", a, b, n, i) for i, ((a, b), n) in enumerate(links.items())] + [("g", b, a, n, i + 20) for i, ((a, b), n) in enumerate(links.items())]
    sizes = spark.createDataFrame(size, "grid_id string, zone_id long, pixels long")
    near = spark.createDataFrame(rows, "grid_id string, zone_id long, neighbour long, contacts long, first_pos long")
    one, many = (zones.merge_small_zones(sizes, near, 6.0, limit).toPandas().sort_values("zone_id").values.tolist() for limit in (100, 2))
    assert one == many and len(one) >= 3


def test_outlines_enclose_each_zone(case):
    _, _, labelled = case
    a = zones.outline_rings(labelled).toPandas().sort_values(["grid_id", "zone_id", "ring_no", "seq"])
    b = zones.outline_rings(labelled, outline_limit=12).toPandas().sort_values(["grid_id", "zone_id", "ring_no", "seq"])
    cols = ["grid_id", "zone_id", "ring_no", "ax", "ay"]
    assert a[cols].values.tolist() == b[cols].values.tolist()
    area = {}
    for key, q in a.groupby(["grid_id", "zone_id", "ring_no"]):
        x, y = q.ax.to_numpy(float), q.ay.to_numpy(float)
        signed = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2
        assert (signed > 0) == (key[2] == 0)
        area[key[:2]] = area.get(key[:2], 0) + signed
    assert area == labelled.toPandas().groupby(["grid_id", "zone_id"]).size().to_dict()


def test_outlines_chained_in_blocks(spark):
    """Rings across many blocks equal those of one block, each closed, numbered and begun at its least edge."""
    rng = np.random.default_rng(5)
    art = np.kron(rng.integers(0, 3, (9, 7)), np.ones((2, 2), int))
    art[rng.random(art.shape) < 0.15] = 1
    rows = [(g, x, y, int(art[y, x] + k)) for k, g in enumerate("ab") for y in range(art.shape[0]) for x in range(art.shape[1])]
    df = spark.createDataFrame(rows, "grid_id string, x int, y int, zone_id int")
    runs = {}
    for name, limit, block in (("whole", 500_000, 256), ("blocks", 500_000, 4), ("doubling", 3, 4)):
        runs[name] = sorted(map(tuple, zones.edge_rings(df, limit, block).collect()))
    assert runs["whole"] == runs["blocks"] == runs["doubling"] and len(runs["whole"]) > 400
    rings = {}
    for g, z, n, seq, ax, ay, h, before in runs["whole"]:
        rings.setdefault((g, z, n), []).append((seq, ax, ay, h, before))
    lows = {}
    for (g, z, n), ring in sorted(rings.items()):
        assert [q[0] for q in ring] == list(range(len(ring))) and min((q[2], q[1], q[3]) for q in ring) == (ring[0][2], ring[0][1], ring[0][3])
        for a, b in zip(ring, [*ring[1:], ring[0]]):
            assert (a[1] + zones.STEP_X[a[3]], a[2] + zones.STEP_Y[a[3]]) == (b[1], b[2]) and b[4] == a[3]
        lows.setdefault((g, z), []).append((ring[0][2], ring[0][1], ring[0][3]))
    assert all(v == sorted(v) for v in lows.values())


def test_zone_polygons_leave_out_their_holes(spark):
    # Rings in rings, holes side by side, and two separate parts of zone 0.
    art = """
        0000000000011
        0111110222011
        0100010222000
        0102010000030
        0100010303030
        0111110000000
        0000000000044
        4444444444444
        0000004404444
    """
    lines = [list(map(int, q)) for q in art.split()][::-1]
    rows = [("g", x, y, c) for y, line in enumerate(lines) for x, c in enumerate(line)]
    df = spark.createDataFrame(rows, "grid_id string, x int, y int, zone_id int")
    for limit in (500_000, 4):
        got = zones.zone_polygons(df, limit).collect()
        total = {}
        for r in got:
            total[r.zone_id] = total.get(r.zone_id, 0) + r.pixels
            shoelace = lambda q: sum(a.ax * b.ay - b.ax * a.ay for a, b in zip(q, [*q[1:], q[0]])) / 2
            assert shoelace(r.ring) > 0 and all(shoelace(h) < 0 for h in r.holes)
            assert shoelace(r.ring) + sum(map(shoelace, r.holes)) == r.pixels
        assert total == {z: sum(line.count(z) for line in lines) for z in range(5)}
        assert sorted((r.zone_id, r.pixels, len(r.holes)) for r in got if r.zone_id < 2) == [(0, 1, 0), (0, 6, 0), (0, 8, 1), (0, 50, 5), (1, 4, 0), (1, 16, 1)]


def test_plane_slope(spark):
    rows = [("g", x, y, 30.0 * x) for x in range(4) for y in range(4)]
    df = spark.createDataFrame(rows, "grid_id string, x int, y int, elev double")
    got = {(r["x"], r["y"]): r for r in terrain.slope_aspect(df, 30.0).collect()}
    assert got[1, 1]["slope"] == pytest.approx(45.0) and got[0, 2]["slope"] == pytest.approx(26.565051, abs=1e-5)
    assert got[1, 1]["aspect"] == pytest.approx(180.0) and got[1, 1]["compass_aspect"] == pytest.approx(270.0)


def test_blocks_of_any_size_agree(spark):
    rng = np.random.default_rng(1)
    rows = [("g", x, y, float(rng.integers(0, 50))) for x in range(13) for y in range(9)]
    df = spark.createDataFrame(rows, "grid_id string, x int, y int, elev double")
    for run in (lambda b: terrain.gradients(df, b), lambda b: terrain.with_neighbours(df, "elev", b)):
        assert sorted(map(tuple, run(4).collect()), key=str) == sorted(map(tuple, run(512).collect()), key=str)


SQUARE = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (0.0, 1000.0)]


def cut(spark, rings, segs, names=None, **kw):
    polys = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "polygon_id long, world_vertices array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(segs)], "ord long, x0 double, y0 double, x1 double, y1 double")
    out = {}
    rows = cutting.cut_polygons(polys, lines, **kw).collect()
    if names is not None:
        names.append(sorted(r["piece_id"] for r in rows))
    for r in rows:
        ring = np.array([(v["x"], v["y"]) for v in r["world_vertices"]])
        x, y = ring[:, 0], ring[:, 1]
        out.setdefault(r["polygon_id"], []).append(round(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2, 3))
    return {k: sorted(v) for k, v in out.items()}


def test_cut_square(spark):
    assert cut(spark, [SQUARE], [(500, -100, 500, 1100)]) == {0: [500000.0, 500000.0]}
    whole = {0: [1000000.0]}
    assert cut(spark, [SQUARE], [(500, -100, 500, 500), (500, 500, 500, 1100)]) == whole
    assert cut(spark, [SQUARE], [(0, 0, 1000, 0), (-10, -10, 1010, 1010)]) == whole


def test_cut_in_batches_gives_the_same(spark):
    rng = np.random.default_rng(3)
    segs = [(a, -50, b, 1050) for a, b in rng.uniform(0, 1000, (6, 2))] + [(-50, a, 1050, b) for a, b in rng.uniform(0, 1000, (5, 2))]
    far = [(x + 5000.0, y) for x, y in SQUARE]
    names = []
    once = cut(spark, [SQUARE, far], segs, names)
    assert once == cut(spark, [SQUARE, far], segs, names, batch=4)
    assert names[0] == names[1] and "1" in names[0] and any(n.startswith("0.0") for n in names[0])
    assert sum(once[0]) == pytest.approx(1e6, abs=200.0) and len(once[0]) > 6 and once[1] == [1000000.0]


def polygon_areas(spark, holes, segs):
    ring = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(0, SQUARE, holes)], f"polygon_id long, world_vertices {ring}, world_holes array<{ring}>")
    lines = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(segs)], "ord long, x0 double, y0 double, x1 double, y1 double")
    cut_ = cutting.cut_polygons(df, lines)
    area = net_area_sqm(cut_.world_vertices, cut_.world_holes)
    return sorted((r["piece_id"], len(r["world_holes"]), round(r["a"] * 1e4, 3)) for r in cut_.withColumn("a", area).collect())


def test_cutting_through_holes(spark):
    hole = [(300.0, 300.0), (300.0, 700.0), (700.0, 700.0), (700.0, 300.0)]
    whole = polygon_areas(spark, [hole], [(500, 250, 500, 350)])
    assert whole == [("0", 1, 840000.0)]
    # Through the hole, then beside what is left of it.
    assert polygon_areas(spark, [hole], [(500, -90, 500, 1090), (-90, 100, 1090, 100)]) == [
        ("0.0l.1l", 1, 370000.0), ("0.0l.1r", 0, 50000.0), ("0.0r.1l", 1, 370000.0), ("0.0r.1r", 0, 50000.0),
    ]
    assert polygon_areas(spark, [hole], [(200, -90, 200, 1090)]) == [("0.0l", 0, 200000.0), ("0.0r", 1, 640000.0)]


def test_split_tree_equals_a_plain_loop():
    rng = np.random.default_rng(9)
    ring = np.array([(0, 0), (1000, 0), (1000, 1000), (600, 1000), (600, 300), (400, 300), (400, 1000), (0, 1000)], float)
    segs = rng.uniform(-200, 1200, (60, 4))
    parts = [("", [ring])]
    for n, s in enumerate(segs):
        nxt = []
        for name, rings in parts:
            halves = cutting.split_rings(rings, s) if cutting.splitters(rings[0], s[None])[0] else None
            nxt += [(f"{name}.{n}{side}", h) for side, h in zip("lr", halves)] if halves else [(name, rings)]
        parts = nxt
    tree = cutting.cut_rings([ring], segs, np.arange(len(segs)))
    assert len(parts) > 30 and {n for n, _ in tree} == {n for n, _ in parts}
    assert all(np.array_equal(dict(tree)[n][0], r[0]) for n, r in parts)


def test_many_segments_on_one_polygon():
    rng = np.random.default_rng(2)
    ring, at = np.array(SQUARE), rng.uniform(0, 1000, (100_000, 2))
    short = np.concatenate([at, at + rng.uniform(-3, 3, at.shape)], axis=1)
    long = np.stack([np.array((x, -50.0, x, 1050.0)) for x in range(10, 1000, 10)])
    start = time.perf_counter()
    parts = cutting.cut_rings([ring], np.concatenate([short, long, short]), np.arange(200_099))
    assert len(parts) >= 98 and time.perf_counter() - start < 20
    assert sum(abs(np.cross(r[0], np.roll(r[0], -1, axis=0)).sum()) / 2 for _, r in parts) == pytest.approx(1e6)


def test_walked_cells_miss_no_segment(spark):
    rng = np.random.default_rng(4)
    rings = [[(x, y), (x + w, y), (x + w, y + w), (x, y + w)] for x, y, w in rng.uniform(1e4, 3e5, (12, 3))]
    rows = [(i, -1, ring) for i, ring in enumerate(rings)]
    pieces = spark.createDataFrame([(i, a, [tuple(map(float, q)) for q in r]) for i, a, r in rows], "piece_id long, after long, world_vertices array<struct<x:double,y:double>>")
    ends = rng.uniform(-1e5, 7e5, (150, 4))
    ends[:10, 2] = ends[:10, 0]
    lines = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "ord long, x0 double, y0 double, x1 double, y1 double")
    near = {(r.piece_id, r.ord) for r in cutting.line_candidates(pieces, lines).collect()}
    boxes = {(r.piece_id, r.ord) for r in cutting.candidate_segments(pieces, lines).collect()}
    cross = {(i, n) for i, r in enumerate(rings) for n in np.flatnonzero(cutting.splitters(np.array(r), ends))}
    assert cross <= near <= boxes and len(near) < len(boxes)


def test_pieces_are_cut_as_a_stream(spark, monkeypatch):
    """Many rings are tested in one go as one by one, and rows in batches of any size give the same parts."""
    rng = np.random.default_rng(12)
    rings = [np.array(SQUARE, float) * rng.uniform(0.2, 2) + rng.uniform(0, 3000, 2) for _ in range(60)] + [np.empty((0, 2))]
    rings += [np.stack([np.cos(a), np.sin(a)], axis=1) * 900 + 1500 for a in [np.linspace(0, 6, 40)]]
    segs = np.concatenate([rng.uniform(0, 4000, (400, 2))] * 2, axis=1) + np.concatenate([np.zeros((400, 2)), rng.uniform(-1500, 1500, (400, 2))], axis=1)
    first = rng.integers(0, 400, len(rings))
    last = np.minimum(first + rng.integers(0, 90, len(rings)), 400)
    at = np.cumsum([0, *map(len, rings)])
    want = [bool(len(r) and b > a and cutting.splitters(r, segs[a:b]).any()) for r, a, b in zip(rings, first, last)]
    assert 5 < sum(want) < len(rings) - 5
    for flat in (1 << 17, 400):
        monkeypatch.setattr(cutting, "FLAT", flat)
        tests = np.diff(at) * (last - first)
        assert (cutting.any_splits(np.concatenate(rings), at, segs, first, last) == (np.array(want) | (tests > flat))).all()

    schema = pa.schema({"piece_id": pa.string(), "polygon_id": pa.int64(), "after": pa.int64(), "more": pa.bool_(), "ord": pa.int64(), "world_vertices": pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))} | {c: pa.float64() for c in ("x0", "y0", "x1", "y1")})
    schema = schema.append(pa.field("world_holes", pa.list_(schema.field("world_vertices").type)))
    rows, parts = [], []
    for n, (ring, a, b) in enumerate(zip(rings, first, last)):
        if len(ring):
            rows.append({"piece_id": f"{n}", "polygon_id": n, "after": -1, "more": False, "world_vertices": [{"x": x, "y": y} for x, y in ring], "world_holes": []})
            rows += [{"piece_id": f"{n}", "ord": o} | dict(zip(("x0", "y0", "x1", "y1"), segs[o])) for o in range(a, b)]
            parts += [(n, f"{n}{name}", p[0].tolist()) for name, p in cutting.cut_rings([ring], segs[a:b], np.arange(a, b))]
    assert len(parts) > len(rings)
    table = pa.Table.from_pylist(rows, schema)
    for size in (1, 7, 10_000):
        found = pa.Table.from_batches(cutting._cut_stream(table.to_batches(size))).to_pylist()
        assert [(r["polygon_id"], r["piece_id"], [[p["x"], p["y"]] for p in r["world_vertices"]]) for r in found] == parts

    polys = spark.createDataFrame([(0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)])], "polygon_id long, world_vertices array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(0, -1.0, 3.0, 99.0, 3.0)], "ord long, x0 double, y0 double, x1 double, y1 double")
    assert "InPandas" not in cutting.cut_polygons(polys, lines)._jdf.queryExecution().executedPlan().toString()  # a frame for each piece
