"""Cutting polygons by polylines.

Segments act in a fixed order (roads, rivers, coastlines; feature order;
vertex order). A segment splits a piece only when the finite segment crosses at
least two edges of its outer ring away from their ends; the piece, holes
included, is then divided by the whole line through the segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import projection as P
from landloom.operators import filters as Fl
from landloom.operators.indexing import dense_index
from landloom.operators.roads import polyline_segments
from landloom.session import checkpointed, spread

CUT_ORDER = {"Road": 0, "River": 1, "Coastline": 2}
EDGE_MARGIN = 0.01
EXTENSION_CM = 1000000.0
BATCH = 50_000
CELL_CM = 20000.0


def cut_segments(features: DataFrame, origin_lon: float, origin_lat: float) -> DataFrame:
    """Cutting segments ``ord, x0, y0, x1, y1`` in world centimetres."""
    lines = features.where(F.col("category").isin(*CUT_ORDER) & (F.col("geom_type") == "LineString"))
    rank = F.lit(0)
    for category, r in CUT_ORDER.items():
        rank = F.when(F.col("category") == category, r).otherwise(rank)
    world = lines.select(
        rank.alias("rank"), "feature_id", P.geo_array_to_world(F.col("coords"), origin_lon, origin_lat).alias("coords")
    )
    seg = polyline_segments(world, ["rank", "feature_id"]).select(
        "rank", "feature_id", "seg_no",
        F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"),
    )
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    seg = seg.where(dx * dx + dy * dy >= 1.0)
    bucket = [F.col("rank"), F.floor(F.col("feature_id") / 65536)]
    return dense_index(seg, bucket, [F.col("feature_id"), F.col("seg_no")], "ord").select("ord", "x0", "y0", "x1", "y1")


def candidate_segments(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments whose box meets a piece's box: ``piece_id, ord, x0 .. y1``.

    Pieces are hashed at a level that matches their extent and segments at each
    level in use; a pair is kept only in the lowest cell both cover.
    """
    ring = F.col("world_vertices")
    box = pieces.select("piece_id", "after", G.bbox(ring, "x", "y").alias("b")).select("piece_id", "after", "b.*")
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1.0))
    level = F.greatest(F.lit(0), F.ceil(F.log(extent / (4.0 * CELL_CM)) / math.log(4.0))).cast("int")
    box = box.withColumn("level", level)
    levels = [r[0] for r in box.select("level").distinct().collect()]  # a handful of integers
    w = F.lit(CELL_CM) * F.pow(F.lit(4.0), F.col("level"))

    def cell(v):
        return F.floor(v / w).cast("long")

    def spread(df, lx, hx, ly, hy):
        df = df.withColumns({"lo_x": cell(lx), "lo_y": cell(ly)})
        df = df.withColumn("cx", F.explode(F.sequence("lo_x", cell(hx))))
        return df.withColumn("cy", F.explode(F.sequence("lo_y", cell(hy))))

    left = spread(box, F.col("min_x"), F.col("max_x"), F.col("min_y"), F.col("max_y"))
    left = left.withColumnsRenamed({"lo_x": "p_lo_x", "lo_y": "p_lo_y"})
    seg = segments.withColumns(
        {"sx0": F.least("x0", "x1"), "sx1": F.greatest("x0", "x1"), "sy0": F.least("y0", "y1"), "sy1": F.greatest("y0", "y1")}
    ).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
    right = spread(seg, F.col("sx0"), F.col("sx1"), F.col("sy0"), F.col("sy1"))
    meets = (
        (F.col("sx0") <= F.col("max_x")) & (F.col("sx1") >= F.col("min_x"))
        & (F.col("sy0") <= F.col("max_y")) & (F.col("sy1") >= F.col("min_y"))
    )
    lowest = (F.col("cx") == F.greatest("lo_x", "p_lo_x")) & (F.col("cy") == F.greatest("lo_y", "p_lo_y"))
    return (
        left.join(right, ["level", "cx", "cy"])
        .where(meets & lowest & (F.col("ord") > F.col("after")))
        .select("piece_id", "ord", "x0", "y0", "x1", "y1")
    )


def line_candidates(pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that pass a cell of a piece's box: ``piece_id, ord, x0 .. y1``.

    As ``candidate_segments``, but a segment is put into the cells its line
    passes, column by column, not into all cells of its box, so a long diagonal road
    costs its length. The cells are widened by a rounding margin.
    """
    box = pieces.select("piece_id", "after", G.bbox(F.col("world_vertices"), "x", "y").alias("b")).select("piece_id", "after", "b.*")
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1.0))
    box = box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log(extent / (4.0 * CELL_CM)) / math.log(4.0))).cast("int"))
    levels = [r[0] for r in box.select("level").distinct().collect()]  # a handful of integers
    w = F.lit(CELL_CM) * F.pow(F.lit(4.0), F.col("level"))
    cell = lambda v: F.floor(v / w).cast("long")
    run = lambda lo, hi: F.explode(F.sequence(cell(lo), cell(hi)))

    left = box.withColumn("cx", run(F.col("min_x"), F.col("max_x"))).withColumn("cy", run(F.col("min_y"), F.col("max_y")))
    seg = segments.withColumns(
        {"sx0": F.least("x0", "x1"), "sx1": F.greatest("x0", "x1"), "sy0": F.least("y0", "y1"), "sy1": F.greatest("y0", "y1")}
    ).withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels] or [F.lit(0)])))
    seg = seg.withColumn("cx", run(F.col("sx0"), F.col("sx1")))
    slope = F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    at = lambda x: F.col("y0") + slope * (F.greatest(F.col("sx0"), F.least(F.col("sx1"), x)) - F.col("x0"))
    ya, yb = at(F.col("cx") * w), at((F.col("cx") + 1) * w)
    margin = w * 1e-6
    low = F.coalesce(F.greatest(F.col("sy0"), F.least(ya, yb) - margin), F.col("sy0"))
    high = F.coalesce(F.least(F.col("sy1"), F.greatest(ya, yb) + margin), F.col("sy1"))
    right = seg.withColumn("cy", run(F.least(low, high), F.greatest(low, high)))
    meets = (
        (F.col("sx0") <= F.col("max_x")) & (F.col("sx1") >= F.col("min_x"))
        & (F.col("sy0") <= F.col("max_y")) & (F.col("sy1") >= F.col("min_y"))
    )
    met = left.join(right, ["level", "cx", "cy"]).where(meets & (F.col("ord") > F.col("after")))
    return met.select("piece_id", "ord", "x0", "y0", "x1", "y1").distinct()


def _meet(ring: np.ndarray, segs: np.ndarray):
    """Line parameters of each ring edge (columns) with each segment (rows)."""
    return _crossed(ring, _follow(ring), segs[:, None])


def _follow(ring: np.ndarray) -> np.ndarray:
    """Each row's next one, the first after the last."""
    return np.concatenate([ring[1:], ring[:1]])


def _crossed(a: np.ndarray, b: np.ndarray, segs: np.ndarray):
    """Line parameters of edges from ``a`` to ``b`` and segments, row by row."""
    edge = b - a
    line = segs[..., 2:] - segs[..., :2]
    apart = segs[..., :2] - a
    denom = edge[..., 0] * line[..., 1] - edge[..., 1] * line[..., 0]
    ok = np.abs(denom) >= G.PARALLEL_EPS
    safe = np.where(ok, denom, 1.0)
    t = (apart[..., 0] * line[..., 1] - apart[..., 1] * line[..., 0]) / safe
    u = (apart[..., 0] * edge[..., 1] - apart[..., 1] * edge[..., 0]) / safe
    return ok, t, u


def splitters(ring: np.ndarray, segs: np.ndarray) -> np.ndarray:
    """Which segments (rows ``x0, y0, x1, y1``) split the ring."""
    ok, t, u = _meet(ring, segs)
    lo, hi = EDGE_MARGIN, 1.0 - EDGE_MARGIN
    return np.count_nonzero(ok & (t > lo) & (t < hi) & (u > lo) & (u < hi), axis=1) >= 2


def ring_halves(ring: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a ring left and right of the line through the segment.

    Vertices and crossing points stand in one array in ring order; each part
    takes those on its side. Empty parts have no rows.
    """
    way = seg[2:] - seg[:2]
    way = way / math.hypot(*way) * EXTENSION_CM
    line = np.concatenate([seg[:2] - way, seg[2:] + way])
    side = (line[2] - line[0]) * (ring[:, 1] - line[1]) - (line[3] - line[1]) * (ring[:, 0] - line[0])
    ok, t, u = (v[0] for v in _meet(ring, line[None]))
    eps = G.PARALLEL_EPS
    ok = ok & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
    points = ring + (_follow(ring) - ring) * np.clip(t, 0.0, 1.0)[:, None]
    every = np.stack([ring, points], axis=1).reshape(-1, 2)
    parts = []
    for keep in (side >= -eps, side <= eps):
        taken = np.stack([keep, (keep != _follow(keep)) & ok], axis=1).ravel()
        parts.append(every[taken])
    return parts[0], parts[1]


def split_rings(rings: list[np.ndarray], seg: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
    """A polygon (outer ring, then holes) cut by a segment's line; None if a side has no area of its own.

    Holes are cut by the same line: one on a side stays whole, one across the line
    becomes a notch of either side.
    """
    halves = ring_halves(rings[0], seg)
    if min(map(len, halves)) < 3:
        return None
    left, right = [halves[0]], [halves[1]]
    for hole in rings[1:]:
        for part, goal in zip(ring_halves(hole, seg), (left, right)):
            if len(part) >= 3:
                goal.append(part)
    return left, right


#: Edges times segments tested at once, of one ring and of many.
TESTS, FLAT = 1 << 20, 1 << 17


def first_splitter(rings: list[np.ndarray], segs: np.ndarray, start: int = 0):
    """``(index, halves)`` of the first segment that splits the polygon, or None.

    Looked for in runs that grow, so that a polygon cut early tests few segments it will not need.
    """
    width = 64
    while start < len(segs):
        upto = min(len(segs), start + max(1, min(width, TESTS // len(rings[0]))))
        for i in np.flatnonzero(splitters(rings[0], segs[start:upto])) + start:
            halves = split_rings(rings, segs[i])
            if halves:
                return int(i), halves
        start, width = upto, width * 4
    return None


def cut_rings(rings: list[np.ndarray], segs: np.ndarray, names: np.ndarray) -> list[tuple[str, list[np.ndarray]]]:
    """``(suffix, rings)`` of the parts of a polygon cut by segments in order.

    A tree of splits: the first segment that splits a part makes two, and each
    goes on with the later segments whose box meets its own. A segment
    is thus held against the parts it can reach, all of them at once, and never
    looked at again where it did not split.
    """
    boxes = np.concatenate([np.minimum(segs[:, :2], segs[:, 2:]), np.maximum(segs[:, :2], segs[:, 2:])], axis=1)
    done, open_ = [], [("", rings, np.arange(len(segs)))]
    while open_:
        name, rings, near = open_.pop()
        low, high = rings[0].min(axis=0), rings[0].max(axis=0)
        own = boxes[near]
        near = near[(own[:, :2] <= high).all(axis=1) & (own[:, 2:] >= low).all(axis=1)]
        found = first_splitter(rings, segs[near])
        if found is None:
            done.append((name, rings))
            continue
        at, halves = found
        open_ += [(f"{name}.{names[near[at]]}{side}", half, near[at + 1 :]) for side, half in zip("rl", reversed(halves))]
    return done


def _flat(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Points (rows ``x, y``) of all rings, and where each ring begins and ends among them."""
    points, at = rings.values, rings.offsets.to_numpy()
    return np.stack([points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1), at


def _rings(rings: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rings)]).astype(np.int32)
    points = np.concatenate(rings) if rings else np.empty((0, 2))
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(points[:, i]) for i in (0, 1)], ["x", "y"]))


def any_splits(points: np.ndarray, at: np.ndarray, segs: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether any of the segments ``first`` to ``last`` of each ring splits it, for many rings in one go.

    Ring ``i`` is ``points[at[i]:at[i + 1]]``. Edges times segments of all rings are tested
    together, ``FLAT`` at a time; a ring with more counts as split (and is looked at by itself).
    """
    edges, held = np.diff(at), last - first
    tests = edges * held
    found = tests > FLAT
    follow = np.arange(len(points)) + 1
    whole = edges > 0
    follow[at[1:][whole] - 1] = at[:-1][whole]
    small = np.flatnonzero(~found & (tests > 0))
    lot = np.cumsum(tests[small]) // FLAT
    for own in np.split(small, np.flatnonzero(np.diff(lot)) + 1):
        if not len(own):
            continue
        # A row for each (ring, segment), then for each edge of its ring.
        ring = np.repeat(own, held[own])
        seg = np.repeat(first[own] - np.cumsum(held[own]) + held[own], held[own]) + np.arange(len(ring))
        count = edges[ring]
        starts = np.cumsum(count) - count
        i = np.repeat(at[ring] - starts, count) + np.arange(int(count.sum()))
        line = np.repeat(segs[seg], count, axis=0)
        ok, t, u = _crossed(points[i], points[follow[i]], line)
        lo, hi = EDGE_MARGIN, 1.0 - EDGE_MARGIN
        cut = np.add.reduceat((ok & (t > lo) & (t < hi) & (u > lo) & (u < hi)).astype(np.int64), starts) >= 2
        found[ring[cut]] = True
    return found


def _cut_group(rows: pa.Table) -> pa.RecordBatch:
    """Apply its segments, in order, to each piece; ``rows`` hold whole groups of pieces and, after them, their segments."""
    rows = rows.combine_chunks()
    column = lambda c: rows.column(c).combine_chunks()
    code = column("piece_id").dictionary_encode().indices.to_numpy()
    is_piece = column("ord").is_null().to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    group = np.cumsum(np.diff(code, prepend=-1) != 0) - 1
    ends = np.append(begin[1:], len(code))
    pieces = np.flatnonzero(is_piece)
    first = (begin + np.add.reduceat(is_piece.astype(np.int64), begin))[group[pieces]]
    last = ends[group[pieces]]
    segs = np.stack([column(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")], axis=1)
    ords = column("ord").fill_null(-1).to_numpy()
    taken = rows.take(pa.array(pieces))
    outer = taken.column("world_vertices").combine_chunks()
    holes = taken.column("world_holes").combine_chunks()
    points, at = _flat(outer)
    hole_points, hole_at = _flat(holes.values)
    of_hole = holes.offsets.to_numpy()
    may = any_splits(points, at, segs, first, last)
    source, names, out, inner = [], [], [], []
    for i, name in enumerate(taken.column("piece_id").to_pylist()):
        rings = [points[at[i] : at[i + 1]], *(hole_points[hole_at[h] : hole_at[h + 1]] for h in range(of_hole[i], of_hole[i + 1]))]
        own = slice(first[i], last[i])
        for suffix, part in cut_rings(rings, segs[own], ords[own]) if may[i] else [("", rings)]:
            source.append(i)
            names.append(name + suffix)
            out.append(part[0])
            inner.append(part[1:])
    source = np.array(source, dtype=np.int64)
    after = np.where(last > first, ords[np.maximum(last, 1) - 1], column("after").take(pa.array(pieces)).to_numpy())
    nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, inner)]).astype(np.int32)), _rings([h for part in inner for h in part]))
    own = [taken.column(c).combine_chunks().take(pa.array(source)) for c in ("polygon_id", "more")]
    columns = [own[0], pa.array(names, pa.string()), pa.array(after[source], pa.int64()), own[1], _rings(out), nested]
    return pa.RecordBatch.from_arrays(columns, ["polygon_id", "piece_id", "after", "more", "world_vertices", "world_holes"])


def _cut_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut pieces as their rows come by, each piece followed by its segments in order; only the last piece waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = batch.column("piece_id").dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(code)) + 1
        if held and held[-1].column("piece_id")[-1] != batch.column("piece_id")[0]:
            starts = np.insert(starts, 0, 0)
        if not len(starts):
            held.append(batch)
            continue
        yield _cut_group(pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))]))
        held = [batch.slice(int(starts[-1]))]
    if held:
        yield _cut_group(pa.Table.from_batches(held))


_RING = "array<struct<x:double,y:double>>"
_PIECE = f"piece_id string, after long, more boolean, world_vertices {_RING}, world_holes array<{_RING}>"
SHAPE = ("polygon_id", "piece_id", "world_vertices", "world_holes")


def cut_polygons(polygons: DataFrame, segments: DataFrame, batch: int = BATCH) -> DataFrame:
    """Cut ``polygon_id, world_vertices`` by ordered segments.

    Returns ``polygon_id, piece_id, world_vertices, world_holes``; slivers are
    dropped. ``world_holes`` of the polygons are cut with them (none, if there is no such column). A
    piece is named by its cuts - segment number and side - so names do not
    depend on ``batch``. Polygons without a segment near are never sent to
    Python. A task streams through its pieces, each with at most ``batch`` of its segments; those that
    none of them splits are told by one test over many pieces. A
    piece with more is cut by the first batch, and its parts - which from then
    on do not affect each other - go on in the next round with the segments near them.
    """
    schema = f"polygon_id {polygons.schema['polygon_id'].dataType.simpleString()}, {_PIECE}"
    segments = checkpointed(segments)
    holes = F.col("world_holes") if "world_holes" in polygons.columns else F.array().cast(f"array<{_RING}>")
    pending = polygons.where(F.size("world_vertices") >= 3).select(
        "polygon_id",
        F.col("polygon_id").cast("string").alias("piece_id"),
        F.lit(-1).cast("long").alias("after"),
        "world_vertices",
        F.coalesce(holes, F.array().cast(f"array<{_RING}>")).alias("world_holes"),
    )
    finished: list[DataFrame] = []

    while True:
        pending = checkpointed(pending)
        pairs = checkpointed(line_candidates(pending, segments))
        load = pairs.groupBy("piece_id").agg((F.count(F.lit(1)) > batch).alias("more"))
        marked = pending.join(load, "piece_id")
        finished.append(pending.join(load, "piece_id", "left_anti").select(*SHAPE))
        heavy = checkpointed(load.where("more").select("piece_id"))
        taken = pairs
        if not heavy.isEmpty():
            crowded = pairs.join(heavy, "piece_id", "left_semi")
            bucket = [F.col("piece_id"), F.floor(F.col("ord") / 65536)]
            ranked = dense_index(crowded, bucket, [F.col("ord")], "_rank", restart=1)
            first = ranked.where(F.col("_rank") < batch).drop("_rank")
            taken = pairs.join(heavy, "piece_id", "left_anti").unionByName(first)
        # A piece and its segments behind it, in order, so that a task streams through its pieces.
        rows = marked.withColumn("ord", F.lit(None).cast("long")).unionByName(taken, allowMissingColumns=True)
        rows = spread(rows, "piece_id").sortWithinPartitions("piece_id", F.col("ord").asc_nulls_first())
        cut = rows.mapInArrow(_cut_stream, schema)
        if heavy.isEmpty():
            finished.append(cut.drop("after", "more"))
            break
        cut = checkpointed(cut)
        finished.append(cut.where("NOT more").drop("after", "more"))
        pending = cut.where("more").drop("more")
    done = finished[0]
    for f in finished[1:]:
        done = done.unionByName(f)
    return Fl.without_slivers(done)
