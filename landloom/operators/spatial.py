"""Spatial joins as equi-joins on grid cells.

Shared ideas
* equal positions and equal shapes are reduced to one before anything shuffles,
  so a hot group of copies costs one row;
* cells carry a summary (count, extent, one sample point) that settles most
  probes without touching single points;
* a cell is opened only where it cannot be settled, and cells hold a bounded
  number of members: where too many fall into one cell, that region is cut into
  finer cells. No cell ever has its members paired wholesale.

The loops below run over grid levels (a handful), never over data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.session import checkpointed, shuffled, spread

CELL_CAPACITY = 128
SPLIT = 4  # a cell is cut SPLIT x SPLIT
SHIFT = 2  # log2(SPLIT)
SWEEP_CAPACITY = 20_000  # segments of a cell that one task sweeps


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def _dist(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _summaries(points: DataFrame, size: float, by: list[str]) -> DataFrame:
    """Per-cell summary of distinct points ``x, y``."""
    return points.groupBy(*by, _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.min(F.struct("x", "y")).alias("sample"),
    )


def _coarser(summaries: DataFrame, levels: int, by: list[str]) -> DataFrame:
    """Summaries of cells ``SPLIT**levels`` times larger."""
    if levels == 0:
        return summaries
    bits = SHIFT * levels
    return summaries.groupBy(*by, F.shiftright("cx", bits).alias("cx"), F.shiftright("cy", bits).alias("cy")).agg(
        F.sum("n").alias("n"),
        F.min("x0").alias("x0"),
        F.max("x1").alias("x1"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.min("sample").alias("sample"),
    )


def _bounded_cell_size(points: DataFrame, start: float, smallest: float, by: list[str]) -> float:
    """Largest cell size, by powers of SPLIT, whose cells respect the capacity."""
    size = float(start)
    while True:
        cells = points.groupBy(*by, _cell(F.col("x"), size), _cell(F.col("y"), size)).agg(F.count(F.lit(1)).alias("n"))
        fullest = cells.agg(F.max("n")).first()[0] or 0
        if fullest <= CELL_CAPACITY or size / SPLIT < smallest:
            return size
        size /= SPLIT


def _cover(df: DataFrame, size: float, reach: Column) -> DataFrame:
    """Expand probes ``px, py`` to the cells within ``reach`` on both axes."""
    lo_x, hi_x = _cell(F.col("px") - reach, size), _cell(F.col("px") + reach, size)
    lo_y, hi_y = _cell(F.col("py") - reach, size), _cell(F.col("py") + reach, size)
    return df.withColumn("cx", F.explode(F.sequence(lo_x, hi_x))).withColumn("cy", F.explode(F.sequence(lo_y, hi_y)))


def _children(df: DataFrame) -> DataFrame:
    """Replace each cell by its SPLIT x SPLIT children."""
    offsets = F.sequence(F.lit(0), F.lit(SPLIT - 1))
    return (
        df.withColumn("_i", F.explode(offsets))
        .withColumn("_j", F.explode(offsets))
        .withColumns({"cx": F.col("cx") * SPLIT + F.col("_i"), "cy": F.col("cy") * SPLIT + F.col("_j")})
        .drop("_i", "_j")
    )


def _bounds_to_probe() -> dict[str, Column]:
    """Least, greatest and sampled distance from the probe to a cell's points."""
    px, py = F.col("px"), F.col("py")
    gap_x = F.greatest(F.col("x0") - px, px - F.col("x1"), F.lit(0.0))
    gap_y = F.greatest(F.col("y0") - py, py - F.col("y1"), F.lit(0.0))
    far_x = F.greatest(F.abs(F.col("x0") - px), F.abs(F.col("x1") - px))
    far_y = F.greatest(F.abs(F.col("y0") - py), F.abs(F.col("y1") - py))
    return {
        "d_min": _dist(gap_x, gap_y),
        "d_max": _dist(far_x, far_y),
        "d_sample": _dist(F.col("sample.x") - px, F.col("sample.y") - py),
    }


def flag_within_radius(
    probes: DataFrame,
    points: DataFrame,
    flag: str,
    probe_x: str = "center_x",
    probe_y: str = "center_y",
    radius: str = "radius",
    cell: float = 3200.0,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Add boolean ``flag``: some point lies strictly within the probe's radius.

    ``points`` has ``x, y``. Each probe starts at the level whose cells match
    its radius, so it touches at most 25 cells whatever its size. A cell whose
    sample or whole extent is within the radius settles the probe; a cell whose
    extent is out of reach is dropped; only cells the circle cuts through are
    opened, level by level, down to cells of bounded population. ``by`` names
    columns that must agree on both sides.
    """
    by = list(by)
    pts = checkpointed(points.select(*by, "x", "y").where("x IS NOT NULL AND y IS NOT NULL").distinct())
    keys = checkpointed(
        probes.select(*by, F.col(probe_x).alias("px"), F.col(probe_y).alias("py"), F.col(radius).alias("r"))
        .where("px IS NOT NULL AND py IS NOT NULL AND r > 0")
        .distinct()
    )
    size = _bounded_cell_size(pts, cell, 1.0, by)
    widest = keys.agg(F.max("r")).first()[0] or 0.0
    top = max(0, math.ceil(math.log(max(widest, 1e-9) / (2.0 * size), SPLIT)))
    level_of = F.greatest(F.lit(0), F.ceil(F.log(F.col("r") / (2.0 * size)) / math.log(SPLIT))).cast("int")
    keys = keys.withColumn("level", F.least(level_of, F.lit(top)))
    base = _summaries(pts, size, by)
    hits, carried = [], None
    key = [*by, "px", "py", "r"]
    cells = [*by, "cx", "cy"]
    for level in range(top, -1, -1):
        width = size * SPLIT**level
        cand = _cover(keys.where(F.col("level") == level).drop("level"), width, F.col("r"))
        if carried is not None:
            cand = cand.unionByName(carried)
        judged = shuffled(cand).join(_coarser(base, level, by), cells).withColumns(_bounds_to_probe())
        settled = (F.col("d_sample") < F.col("r")) | (F.col("d_max") < F.col("r"))
        judged = judged.where(F.col("d_min") < F.col("r")).select(*key, "cx", "cy", settled.alias("hit"))
        if top > 0 and level > 0:
            judged = checkpointed(judged)
        found = judged.where("hit").select(*key).distinct()
        open_cells = shuffled(judged.where("NOT hit")).join(found, key, "left_anti").select(*key, "cx", "cy")
        hits.append(found)
        carried = _children(open_cells) if level > 0 else open_cells
    exact = (
        shuffled(carried).join(pts.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)}), cells)
        .where(_dist(F.col("x") - F.col("px"), F.col("y") - F.col("py")) < F.col("r"))
        .select(*key)
    )
    near = exact
    for h in hits:
        near = near.unionByName(h)
    near = near.distinct().select(
        *by, F.col("px").alias(probe_x), F.col("py").alias(probe_y), F.col("r").alias(radius), F.lit(True).alias("_near")
    )
    return (
        shuffled(probes).join(near, [*by, probe_x, probe_y, radius], "left")
        .withColumn(flag, F.coalesce("_near", F.lit(False)))
        .select(*probes.columns, flag)
    )


def nearest_within(
    probes: DataFrame, nodes: DataFrame, tolerance: float, probe_id: str = "probe_id", node_id: str = "node_id"
) -> DataFrame:
    """Nearest node strictly within the tolerance for each probe.

    Both inputs have an id and ``x, y``. Ties go to the lowest node id. Returns
    ``probe_id, node_id, distance``; probes without a node in reach are absent.
    Cells farther than the best sampled distance of a probe are never opened.
    """
    spots = checkpointed(nodes.groupBy("x", "y").agg(F.min(node_id).alias("nid")))
    keys = probes.select(F.col("x").alias("px"), F.col("y").alias("py")).distinct()
    size = _bounded_cell_size(spots, tolerance, tolerance / SPLIT**6, [])
    levels = round(math.log(tolerance / size, SPLIT))
    cand = _cover(keys, tolerance, F.lit(float(tolerance)))
    base = _summaries(spots, size, []) if levels else None
    for level in range(levels, 0, -1):
        judged = shuffled(cand).join(_coarser(base, level, []), ["cx", "cy"]).withColumns(_bounds_to_probe())
        judged = checkpointed(judged.where(F.col("d_min") < tolerance).select("px", "py", "cx", "cy", "d_min", "d_sample"))
        best = judged.groupBy("px", "py").agg(F.min("d_sample").alias("bound"))
        cand = _children(judged.join(best, ["px", "py"]).where("d_min <= bound").select("px", "py", "cx", "cy"))
    d = _dist(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    pairs = (
        shuffled(cand).join(spots.withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)}), ["cx", "cy"])
        .withColumn("distance", d)
        .where(F.col("distance") < tolerance)
    )
    best = pairs.groupBy("px", "py").agg(F.min(F.struct("distance", "nid")).alias("_m"))
    best = best.select(
        F.col("px").alias("x"), F.col("py").alias("y"), F.col("_m.nid").alias(node_id), F.col("_m.distance").alias("distance")
    )
    return shuffled(probes.select(probe_id, "x", "y")).join(best, ["x", "y"]).select(probe_id, node_id, "distance")


def _edges_of(rings: DataFrame, keep: list[str]) -> DataFrame:
    return G.explode_edges(rings, "ring", keep, "lon", "lat")


def flag_inside_any(
    points: DataFrame,
    areas: DataFrame,
    flag: str,
    point_lon: str = "geo_lon",
    point_lat: str = "geo_lat",
    ring: str = "coords",
    min_edge_height: float = 0.0,
    cell: float = 0.0005,
    pair_limit: int = 200_000,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Add boolean ``flag``: the point is inside some area (even-odd rule).

    Areas are cut into cells at a level that matches their extent. Cells wholly
    inside an area settle their points as a group, without pairing; only cells
    an outline passes through lead to point-area pairs, and those are refined
    while a cell would still pair too much. A pair then meets only the edges in
    its own latitude strip of the area, so an outline of a million vertices is
    read in strips of a few edges. ``min_edge_height`` leaves flatter edges out
    of the parity count.
    """
    by = list(by)
    cell_key = [*by, "level", "cx", "cy"]
    pts = points.select(*by, F.col(point_lon).alias("px"), F.col(point_lat).alias("py"))
    pts = checkpointed(pts.where("px IS NOT NULL AND py IS NOT NULL").distinct())
    shapes = areas.where(F.size(ring) >= 3).select(*by, F.col(ring).alias("ring")).distinct()
    shapes = shapes.withColumn("wid", F.sha1(F.concat_ws("/", *by, F.to_json("ring")))).withColumn("_b", G.bbox(F.col("ring")))
    shapes = shapes.select(*by, "wid", "ring", "_b.*")
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(extent, F.lit(1e-12)) / (4.0 * cell)) / math.log(SPLIT)))
    shapes = checkpointed(shapes.withColumn("level", level.cast("int")))
    edges = _edges_of(shapes.select("wid", "ring"), ["wid"])
    tall = F.abs(F.col("by") - F.col("ay")) >= min_edge_height

    def width(lv: Column) -> Column:
        return F.lit(float(cell)) * F.pow(F.lit(float(SPLIT)), lv)

    def point_keys(levels: list[int]) -> DataFrame:
        keyed = pts.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        w = width(F.col("level"))
        return keyed.withColumns(
            {"cx": F.floor(F.col("px") / w).cast("long"), "cy": F.floor(F.col("py") / w).cast("long")}
        )

    w = width(F.col("level"))
    cells = shapes.select(*by, "wid", "level", "min_lon", "min_lat", "max_lon", "max_lat").withColumn(
        "cx",
        F.explode(F.sequence(F.floor(F.col("min_lon") / w).cast("long"), F.floor(F.col("max_lon") / w).cast("long"))),
    ).withColumn(
        "cy",
        F.explode(F.sequence(F.floor(F.col("min_lat") / w).cast("long"), F.floor(F.col("max_lat") / w).cast("long"))),
    ).select("wid", *cell_key)

    inside, pairs = [], []
    while True:
        levels = [r[0] for r in cells.select("level").distinct().collect()]  # a handful of integers
        if not levels:
            break
        occupied = point_keys(levels).groupBy(*cell_key).agg(F.count(F.lit(1)).alias("n_points"))
        judged = checkpointed(_judge_cells(cells.join(occupied, cell_key), edges, tall, width, cell_key))
        full = judged.where("state = 'full'").select(*cell_key).distinct()
        settled = point_keys(levels).join(full, cell_key, "left_semi").select(*by, "px", "py")
        inside.append(settled)
        cut = judged.where("state = 'cut'").join(full, cell_key, "left_anti")
        load = cut.groupBy(*cell_key).agg((F.count(F.lit(1)) * F.max("n_points")).alias("load"))
        hot = load.where((F.col("load") > pair_limit) & (F.col("level") > -8)).select(*cell_key)
        hot = checkpointed(hot)
        pairs.append(
            point_keys(levels).join(
                cut.join(hot, cell_key, "left_anti").select(*cell_key, "wid"), cell_key
            ).select(*by, "px", "py", "wid")
        )
        if hot.isEmpty():
            break
        cells = _children(cut.join(hot, cell_key, "left_semi").select("wid", *cell_key))
        cells = checkpointed(cells.withColumn("level", F.col("level") - 1))

    if not pairs:
        return points.withColumn(flag, F.lit(False))
    candidates, settled = pairs[0], inside[0]
    for p in pairs[1:]:
        candidates = candidates.unionByName(p)
    for p in inside[1:]:
        settled = settled.unionByName(p)
    decided = _parity(candidates.distinct(), shapes, edges.where(tall), by).unionByName(settled).distinct()
    decided = decided.select(*by, F.col("px").alias(point_lon), F.col("py").alias(point_lat), F.lit(True).alias("_in"))
    return (
        shuffled(points).join(decided, [*by, point_lon, point_lat], "left")
        .withColumn(flag, F.coalesce("_in", F.lit(False)))
        .select(*points.columns, flag)
    )


def _judge_cells(cells: DataFrame, edges: DataFrame, tall: Column, width, cell_key: list[str]) -> DataFrame:
    """State of each (area, cell): ``full``, ``cut``; cells outside are dropped.

    Edges are walked row of cells by row of cells: they cut the cells they pass
    through, and where they cross the middle of a row the cells to the west have
    one more crossing. A cell that no edge passes and whose row holds no
    left-out edge is uniform; its count then speaks for every point in it. The
    rows made grow with the length of the outline, not with cells times edges.
    """
    w = width(F.col("level"))
    slack = 1e-9
    row_key = ["wid", "level", "cy"]
    rows_used = cells.select(*row_key).distinct()

    def index(v: Column) -> Column:
        return F.floor(v / w).cast("long")

    walked = edges.join(cells.select("wid", "level").distinct(), "wid").withColumn(
        "cy", F.explode(F.sequence(index(F.least("ay", "by") - slack), index(F.greatest("ay", "by") + slack)))
    )
    walked = checkpointed(walked.join(rows_used, row_key, "left_semi"))
    rise = F.col("by") - F.col("ay")

    def x_at(y: Column) -> Column:
        part = F.when(rise == 0.0, F.lit(0.0)).otherwise((y - F.col("ay")) / F.when(rise == 0.0, F.lit(1.0)).otherwise(rise))
        return F.col("ax") + (F.col("bx") - F.col("ax")) * F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))

    low, high = F.col("cy") * w - slack, (F.col("cy") + 1) * w + slack
    level_edge = rise == 0.0
    ends = [F.when(level_edge, F.col("ax")).otherwise(x_at(low)), F.when(level_edge, F.col("bx")).otherwise(x_at(high))]
    passed = walked.where(tall).withColumn(
        "cx", F.explode(F.sequence(index(F.least(*ends) - slack), index(F.greatest(*ends) + slack)))
    )
    passed = passed.select(*row_key, "cx").distinct().withColumn("_cut", F.lit(True))
    left_out = walked.where(~tall & (F.col("ay") != F.col("by"))).select(*row_key).distinct().withColumn("_flat", F.lit(True))

    middle = (F.col("cy") + 0.5) * w
    spans = (F.col("ay") > middle) != (F.col("by") > middle)
    at = F.try_divide((F.col("bx") - F.col("ax")) * (middle - F.col("ay")), rise) + F.col("ax")
    crossed = walked.where(tall & spans).select(*row_key, index(at).alias("cx")).groupBy(*row_key, "cx").agg(F.count(F.lit(1)).alias("n"))
    marks = crossed.withColumn("_cell", F.lit(False)).unionByName(
        cells.select(*row_key, "cx", F.lit(0).cast("long").alias("n"), F.lit(True).alias("_cell"))
    )
    east = W.partitionBy(*row_key).orderBy(F.desc("cx")).rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = marks.withColumn("crossings", F.sum("n").over(east)).where("_cell").select(*row_key, "cx", "crossings")
    judged = cells.join(counted, [*row_key, "cx"]).join(passed, [*row_key, "cx"], "left").join(left_out, row_key, "left")
    state = F.when(F.coalesce("_cut", "_flat", F.lit(False)), "cut").when(F.col("crossings") % 2 == 1, "full")
    return judged.select(*cell_key, "wid", "n_points", state.alias("state")).where("state IS NOT NULL")


def _parity(pairs: DataFrame, shapes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Points of ``pairs`` (px, py, wid) inside their area, by latitude strips."""
    strips = F.least(F.greatest(F.ceil(F.size("ring") / 4.0), F.lit(1)), F.lit(65536))
    meta = shapes.select(
        "wid",
        F.col("min_lat").alias("y_lo"),
        F.col("max_lat").alias("y_hi"),
        F.col("min_lon").alias("x_lo"),
        F.col("max_lon").alias("x_hi"),
        F.greatest((F.col("max_lat") - F.col("min_lat")) / strips, F.lit(1e-12)).alias("strip_h"),
    )

    def strip(y: Column) -> Column:
        return F.floor((y - F.col("y_lo")) / F.col("strip_h")).cast("long")

    banded = edges.join(meta, "wid").withColumn(
        "strip", F.explode(F.sequence(strip(F.least("ay", "by")), strip(F.greatest("ay", "by"))))
    )
    probed = (
        pairs.join(meta, "wid")
        .where(F.col("py").between(F.col("y_lo"), F.col("y_hi")) & F.col("px").between(F.col("x_lo"), F.col("x_hi")))
        .withColumn("strip", strip(F.col("py")))
        .select(*by, "wid", "strip", "px", "py")
    )
    crosses = G.edge_crosses_ray(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return (
        probed.join(banded.select("wid", "strip", "ax", "ay", "bx", "by"), ["wid", "strip"])
        .where(crosses)
        .groupBy(*by, "px", "py", "wid")
        .agg((F.count(F.lit(1)) % 2).alias("odd"))
        .where("odd = 1")
        .select(*by, "px", "py")
    )


def _segment_cells(df: DataFrame, size: float, within_parent: bool = False) -> DataFrame:
    """Cells a segment ``x0 y0 x1 y1`` passes through (column by column)."""
    lo_x, hi_x = F.least("x0", "x1"), F.greatest("x0", "x1")
    if within_parent:
        first, last = F.col("cx") * SPLIT, F.col("cx") * SPLIT + (SPLIT - 1)
        first = F.greatest(first, _cell(lo_x, size))
        last = F.least(last, _cell(hi_x, size))
        parent_lo, parent_hi = F.col("cy") * SPLIT, F.col("cy") * SPLIT + (SPLIT - 1)
    else:
        first, last = _cell(lo_x, size), _cell(hi_x, size)
        parent_lo = parent_hi = None
    columns = F.when(first <= last, F.sequence(first, last))
    df = df.withColumn("_cx", F.explode(columns))
    dx = F.col("x1") - F.col("x0")
    left = F.greatest(lo_x, F.col("_cx") * float(size))
    right = F.least(hi_x, (F.col("_cx") + 1) * float(size))

    def y_at(x: Column) -> Column:
        return F.when(dx == 0.0, F.col("y0")).otherwise(
            F.col("y0") + (F.col("y1") - F.col("y0")) * (x - F.col("x0")) / F.when(dx == 0.0, 1.0).otherwise(dx)
        )

    y_a = F.when(dx == 0.0, F.col("y0")).otherwise(y_at(left))
    y_b = F.when(dx == 0.0, F.col("y1")).otherwise(y_at(right))
    slack = float(size) * 1e-6
    lo = F.greatest(F.least(y_a, y_b) - slack, F.least("y0", "y1") - slack)
    hi = F.least(F.greatest(y_a, y_b) + slack, F.greatest("y0", "y1") + slack)
    first_y, last_y = _cell(lo, size), _cell(hi, size)
    if parent_lo is not None:
        first_y, last_y = F.greatest(first_y, parent_lo), F.least(last_y, parent_hi)
    df = df.withColumn("_cy", F.explode(F.when(first_y <= last_y, F.sequence(first_y, last_y))))
    return df.withColumns({"cx": F.col("_cx"), "cy": F.col("_cy")}).drop("_cx", "_cy")


def crossing_segments(segments: DataFrame, cell: float, eps: float = 0.001, max_depth: int = 8, capacity: int = SWEEP_CAPACITY) -> DataFrame:
    """Pairs of segments that cross strictly inside both.

    ``segments``: ``seg_id, n0, n1, x0, y0, x1, y1``. Segments that share an
    end node are no pair. Returns ``a_id, b_id`` (a < b) with the parameters
    ``t, u`` and the crossing ``x, y``. Segments between the same two nodes are
    reduced to one before pairing and expanded only in the found crossings.

    The segments of a cell are swept in order of x (``_sweep_cells``), many cells to a task.
    Only cells above ``capacity`` segments are cut finer first, so that no
    task takes an unbounded cell. Segments that meet in one node stay together
    however fine the cells are, and need no pairing among themselves: such a
    cell's busiest node is its hub, only the segments beside it count as crowd.
    """
    ends = ["n0", "n1", "x0", "y0", "x1", "y1"]
    distinct = checkpointed(segments.groupBy(*ends).agg(F.min("seg_id").alias("sid")))
    pending = _segment_cells(distinct, cell)
    size, found = float(cell), []
    for depth in range(max_depth + 1):
        load = pending.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
        crowded = checkpointed(load.where(F.col("n") > capacity))
        if crowded.isEmpty():
            found.append(_sweep_cells(pending, eps))
            break
        pending = checkpointed(pending)
        node = F.explode(F.array_distinct(F.array("n0", "n1"))).alias("node")
        degrees = pending.join(crowded, ["cx", "cy"]).select("cx", "cy", "n", node).groupBy("cx", "cy", "n", "node").agg(F.count(F.lit(1)).alias("d"))
        hubs = degrees.groupBy("cx", "cy", "n").agg(F.max(F.struct("d", "node")).alias("h"))
        hubs = checkpointed(hubs.select("cx", "cy", F.col("h.node").alias("hub"), (F.col("n") - F.col("h.d")).alias("beside")))
        hot = hubs.where(F.col("beside") > capacity).select("cx", "cy")
        last = depth == max_depth or hot.isEmpty()
        settled = pending if last else pending.join(hot, ["cx", "cy"], "left_anti")
        found.append(_sweep_cells(settled.join(crowded.select("cx", "cy"), ["cx", "cy"], "left_anti"), eps))
        # Around a hub, pairs have at least one segment beside it.
        found.append(_cross_in_cells(settled.join(hubs.select("cx", "cy", "hub"), ["cx", "cy"]), eps))
        if last:
            break
        size /= SPLIT
        pending = _segment_cells(pending.join(hot, ["cx", "cy"], "left_semi"), size, within_parent=True)
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = pairs.dropDuplicates(["sid_a", "sid_b"])
    copies = segments.join(distinct, ends).select("seg_id", "sid")
    expanded = pairs.join(copies.select(F.col("seg_id").alias("a_id"), F.col("sid").alias("sid_a")), "sid_a").join(
        copies.select(F.col("seg_id").alias("b_id"), F.col("sid").alias("sid_b")), "sid_b"
    )
    swap = F.col("a_id") > F.col("b_id")
    return expanded.select(
        F.least("a_id", "b_id").alias("a_id"),
        F.greatest("a_id", "b_id").alias("b_id"),
        F.when(swap, F.col("u")).otherwise(F.col("t")).alias("t"),
        F.when(swap, F.col("t")).otherwise(F.col("u")).alias("u"),
        "x",
        "y",
    )


#: Pairs held against each other at once.
PAIRS = 1 << 20


def _overlapping(group: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Index pairs (runs of arrays) whose ranges overlap within a group.

    Rows are sorted by (group, low). A row's partners stand right behind it, up
    to the last one that begins before it ends: one search gives their number.
    """
    order = np.unique(np.concatenate([low, high]), return_inverse=True)[1]
    wide = int(order.max(initial=0)) + 1
    begins, ends = group * wide + order[: len(low)], group * wide + order[len(low) :]
    count = np.searchsorted(begins, ends, side="right") - np.arange(len(low)) - 1
    upto = np.cumsum(count)
    at = 0
    while at < len(low):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        a = np.repeat(np.arange(at, stop), count[at:stop])
        yield a, a + 1 + np.arange(len(a)) - np.repeat(upto[at:stop] - count[at:stop] - done, count[at:stop])
        at = stop


def _sweep_cells(cells: DataFrame, eps: float) -> DataFrame:
    """Crossings within cells: a sweep over x, candidates kept where their y ranges meet, too."""
    keys = ["cx", "cy"]
    sid = cells.schema["sid"].dataType.simpleString()
    names = ["sid_a", "sid_b", "t", "u", "x", "y"]

    def crossings(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        cx, cy, x0, y0, x1, y1 = (rows.column(c).to_numpy() for c in ("cx", "cy", "x0", "y0", "x1", "y1"))
        fresh = np.concatenate([[False], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
        nodes = pa.concat_arrays([c for n in ("n0", "n1") for c in rows.column(n).chunks]).dictionary_encode().indices.to_numpy()
        n0, n1 = nodes[: len(x0)], nodes[len(x0) :]
        low_y, high_y = np.minimum(y0, y1), np.maximum(y0, y1)
        rank = rows.column("sid").to_numpy()
        out = []
        for a, b in _overlapping(np.cumsum(fresh), np.minimum(x0, x1), np.maximum(x0, x1)):
            near = (low_y[a] <= high_y[b]) & (low_y[b] <= high_y[a])
            near &= (n0[a] != n0[b]) & (n0[a] != n1[b]) & (n1[a] != n0[b]) & (n1[a] != n1[b])
            a, b = a[near], b[near]
            a, b = np.where(rank[a] < rank[b], a, b), np.where(rank[a] < rank[b], b, a)
            ax, ay, bx, by = x1[a] - x0[a], y1[a] - y0[a], x1[b] - x0[b], y1[b] - y0[b]
            px, py = x0[b] - x0[a], y0[b] - y0[a]
            denom = ax * by - ay * bx
            ok = np.abs(denom) >= G.PARALLEL_EPS
            a, b, ax, ay, bx, by, px, py, denom = (v[ok] for v in (a, b, ax, ay, bx, by, px, py, denom))
            t, u = (px * by - py * bx) / denom, (px * ay - py * ax) / denom
            ok = (t > eps) & (t < 1.0 - eps) & (u > eps) & (u < 1.0 - eps)
            out.append((a[ok], b[ok], t[ok], u[ok], (x0[a] + ax * t)[ok], (y0[a] + ay * t)[ok]))
        a, b, *rest = (np.concatenate(v) for v in zip(*out))
        own = rows.column("sid")
        return pa.RecordBatch.from_arrays([own.take(pa.array(i)).combine_chunks() for i in (a, b)] + [pa.array(v) for v in rest], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Cells are sorted: all but the last one of this batch are complete.
            cx, cy = batch.column("cx").to_numpy(), batch.column("cy").to_numpy()
            open_ = np.flatnonzero((cx != cx[-1]) | (cy != cy[-1]))
            whole = int(open_[-1]) + 1 if len(open_) else 0
            if held and not whole and (held[-1].column("cx")[-1].as_py(), held[-1].column("cy")[-1].as_py()) != (int(cx[0]), int(cy[0])):
                yield crossings(pa.Table.from_batches(held))
                held = []
            if whole:
                yield crossings(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held = []
            held.append(batch.slice(whole))
        if held:
            yield crossings(pa.Table.from_batches(held))

    rows = cells.select(*keys, "sid", "n0", "n1", "x0", "y0", "x1", "y1", F.least("x0", "x1").alias("_lo"))
    rows = spread(rows, *keys).sortWithinPartitions(*keys, "_lo")
    return rows.mapInArrow(run, f"sid_a {sid}, sid_b {sid}, t double, u double, x double, y double")


def _cross_in_cells(cells: DataFrame, eps: float) -> DataFrame:
    cols = ["sid", "n0", "n1", "x0", "y0", "x1", "y1"]
    at_hub = F.coalesce((F.col("n0") == F.col("hub")) | (F.col("n1") == F.col("hub")), F.lit(False))
    marked = cells.withColumn("_at_hub", at_hub)
    a = marked.where(~F.col("_at_hub")).select("cx", "cy", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = marked.select("cx", "cy", "_at_hub", *[F.col(c).alias(f"b_{c}") for c in cols])
    apart = (
        (F.col("a_n0") != F.col("b_n0"))
        & (F.col("a_n0") != F.col("b_n1"))
        & (F.col("a_n1") != F.col("b_n0"))
        & (F.col("a_n1") != F.col("b_n1"))
    )
    joined = a.join(b, ["cx", "cy"]).where((F.col("_at_hub") | (F.col("a_sid") < F.col("b_sid"))) & apart)
    # The segment of the lower id comes first, whichever side it was on.
    first = F.col("a_sid") < F.col("b_sid")
    lower = F.when(first, F.struct(*[F.col(f"a_{c}").alias(c) for c in cols])).otherwise(F.struct(*[F.col(f"b_{c}").alias(c) for c in cols]))
    upper = F.when(first, F.struct(*[F.col(f"b_{c}").alias(c) for c in cols])).otherwise(F.struct(*[F.col(f"a_{c}").alias(c) for c in cols]))
    pair = joined.select(lower.alias("p"), upper.alias("q"))
    t, u, denom = G.line_parameters(*[F.col(f"{s}.{c}") for s in "pq" for c in ("x0", "y0", "x1", "y1")])
    hit = pair.withColumns({"t": t, "u": u, "_d": F.abs(denom)}).where(
        (F.col("_d") >= G.PARALLEL_EPS)
        & (F.col("t") > eps)
        & (F.col("t") < 1.0 - eps)
        & (F.col("u") > eps)
        & (F.col("u") < 1.0 - eps)
    )
    return hit.select(
        F.col("p.sid").alias("sid_a"),
        F.col("q.sid").alias("sid_b"),
        "t",
        "u",
        (F.col("p.x0") + (F.col("p.x1") - F.col("p.x0")) * F.col("t")).alias("x"),
        (F.col("p.y0") + (F.col("p.y1") - F.col("p.y0")) * F.col("t")).alias("y"),
    )
