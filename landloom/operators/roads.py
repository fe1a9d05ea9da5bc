"""Road network graph: nodes, edges, splitting at crossings, turn order.

Node positions are ``lon, lat`` times 100 000 ("units"); vertices within 100
units of an earlier node share it, which is about a thousandth of a degree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions import tags as K
from landloom.operators import spatial
from landloom.operators.indexing import dense_index
from landloom.session import checkpointed, spread

UNITS_PER_DEGREE = 100000.0
MERGE_TOLERANCE = 100.0
SPLIT_TOLERANCE = 50.0
BLOCK = 128
OPEN, LEADER, MERGED = 0, 1, 2


def polyline_segments(lines: DataFrame, keep: list[str], coords: str = "coords") -> DataFrame:
    """Consecutive vertex pairs: ``keep, seg_no, a, b``."""
    pairs = F.arrays_zip(
        F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0))).alias("a"),
        F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0))).alias("b"),
    )
    return lines.where(F.size(coords) >= 2).select(*keep, F.posexplode(pairs).alias("seg_no", "_p")).select(
        *keep, "seg_no", F.col("_p.a").alias("a"), F.col("_p.b").alias("b")
    )


def road_vertices(roads: DataFrame) -> DataFrame:
    """Vertices of roads with at least two: ``feature_id, vertex_no, x, y, lon, lat``."""
    v = roads.where(F.size("coords") >= 2).select("feature_id", F.posexplode("coords").alias("vertex_no", "_p"))
    return v.select(
        "feature_id",
        "vertex_no",
        (F.col("_p.lon") * UNITS_PER_DEGREE).alias("x"),
        (F.col("_p.lat") * UNITS_PER_DEGREE).alias("y"),
        F.col("_p.lon").alias("lon"),
        F.col("_p.lat").alias("lat"),
    )


def _near(cells: dict, cx: int, cy: int, x: float, y: float, tolerance: float) -> tuple[float, int] | None:
    """``(distance squared, ord)`` of the nearest entry within the tolerance, the first on ties."""
    best = None
    for i in (cx - 1, cx, cx + 1):
        for j in (cy - 1, cy, cy + 1):
            for px, py, o in cells.get((i, j), ()):
                d = (px - x) ** 2 + (py - y) ** 2
                if d < tolerance * tolerance and (best is None or (d, o) < best):
                    best = (d, o)
    return best


def _settle(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """Decide, in order, the positions of one block as far as its rim lets it.

    A position near an earlier leader has merged; one whose earlier neighbours
    have all merged is a leader; else an open neighbour on the rim decides later.
    """
    leaders: dict[tuple[int, int], list] = {}
    waiting: dict[tuple[int, int], list] = {}
    out = []
    for r in pdf.sort_values("ord").itertuples(index=False):
        state = r.state
        if state == OPEN and r.own and _near(leaders, r.cx, r.cy, r.x, r.y, tolerance):
            state = MERGED
        elif state == OPEN and r.own and not _near(waiting, r.cx, r.cy, r.x, r.y, tolerance):
            state = LEADER
        if state != MERGED:
            (leaders if state == LEADER else waiting).setdefault((r.cx, r.cy), []).append((r.x, r.y, r.ord))
        if r.own:
            out.append((r.x, r.y, r.ord, r.cx, r.cy, state))
    return pd.DataFrame(out, columns=["x", "y", "ord", "cx", "cy", "state"])


def _follow(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """Give every position of a block the nearest leader that came before it, or itself."""
    leaders: dict[tuple[int, int], list] = {}
    out = []
    for r in pdf.sort_values("ord").itertuples(index=False):
        if r.state == LEADER:
            leaders.setdefault((r.cx, r.cy), []).append((r.x, r.y, r.ord))
        if r.own:
            out.append((r.x, r.y, r.ord if r.state == LEADER else _near(leaders, r.cx, r.cy, r.x, r.y, tolerance)[1]))
    return pd.DataFrame(out, columns=["x", "y", "leader"])


def _with_rim(spots: DataFrame, block: int) -> DataFrame:
    """Spots by block of cells; those on a block's rim go to the blocks beside it, too."""

    def shifts(c: str):
        at = F.pmod(c, F.lit(block))
        return F.array_compact(F.array(F.lit(0), F.when(at == 0, -1), F.when(at == block - 1, 1)))

    dealt = spots.withColumn("_i", F.explode(shifts("cx"))).withColumn("_j", F.explode(shifts("cy")))
    dealt = dealt.withColumns(
        {
            "bx": F.floor(F.col("cx") / block) + F.col("_i"),
            "by": F.floor(F.col("cy") / block) + F.col("_j"),
            "own": (F.col("_i") == 0) & (F.col("_j") == 0),
        }
    )
    return spread(dealt.drop("_i", "_j"), "bx", "by")


def merge_positions(positions: DataFrame, tolerance: float, block: int = BLOCK) -> DataFrame:
    """First-come merging of positions ``x, y, ord`` (``ord`` unique).

    In ``ord`` order, a position within the tolerance of existing leaders joins
    the nearest one, otherwise it becomes a leader. Returns ``x, y, ord,
    leader`` with the leader's ``ord``.

    Only the first copy of an equal position takes part. Blocks of cells of
    tolerance size are replayed side by side, each with its rim; what hangs on
    an open position of the rim waits for the next round. A round settles all
    of a chain of positions that lies in one block, so the number of rounds is
    the number of block borders that the longest such chain crosses.
    """
    spots = positions.groupBy("x", "y").agg(F.min("ord").alias("ord"))
    cell = [F.floor(F.col(c) / float(tolerance)).cast("long").alias(f"c{c}") for c in ("x", "y")]
    spots = checkpointed(spots.select("x", "y", "ord", *cell, F.lit(OPEN).alias("state")))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return _settle(pdf, float(tolerance))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        return _follow(pdf, float(tolerance))

    while True:
        blocks = _with_rim(spots, block).groupBy("bx", "by")
        spots = checkpointed(blocks.applyInPandas(settle, "x double, y double, ord long, cx long, cy long, state int"))
        if spots.where(F.col("state") == OPEN).isEmpty():
            break
    led = _with_rim(spots, block).groupBy("bx", "by").applyInPandas(follow, "x double, y double, leader long")
    return positions.join(led, ["x", "y"]).select("x", "y", "ord", "leader")


def build_graph(roads: DataFrame, tolerance: float = MERGE_TOLERANCE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of road features before splitting.

    Nodes ``node_id, x, y, lon, lat`` are numbered in order of first use, edges
    ``edge_id, n0, n1, road_class`` in feature and vertex order.
    """
    vertices = road_vertices(roads)
    ordered = checkpointed(
        dense_index(vertices, [F.floor(F.col("feature_id") / 65536)], [F.col("feature_id"), F.col("vertex_no")], "ord")
    )
    merged = merge_positions(ordered.select("x", "y", "ord"), tolerance, block)
    led = checkpointed(ordered.join(merged.select("ord", "leader"), "ord"))
    leads = led.where("ord = leader").select("ord", "x", "y", "lon", "lat")
    nodes = checkpointed(dense_index(leads, [F.floor(F.col("ord") / 65536)], [F.col("ord")], "node_id"))
    placed = led.join(nodes.select(F.col("ord").alias("leader"), "node_id"), "leader")
    step = placed.select("feature_id", F.col("vertex_no"), "node_id")
    after = placed.select("feature_id", (F.col("vertex_no") - 1).alias("vertex_no"), F.col("node_id").alias("n1"))
    links = step.join(after, ["feature_id", "vertex_no"]).where("node_id <> n1")
    cls = roads.select("feature_id", F.coalesce(K.tag(F.col("props"), "highway"), F.lit("unclassified")).alias("road_class"))
    links = links.join(cls, "feature_id").withColumnRenamed("node_id", "n0")
    edges = dense_index(links, [F.floor(F.col("feature_id") / 65536)], [F.col("feature_id"), F.col("vertex_no")], "edge_id")
    return nodes.drop("ord"), checkpointed(edges.select("edge_id", "n0", "n1", "road_class"))


def edge_segments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the positions of their ends, as crossing-join input."""
    a = nodes.select(F.col("node_id").alias("n0"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = nodes.select(F.col("node_id").alias("n1"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.select(F.col("edge_id").alias("seg_id"), "n0", "n1").join(a, "n0").join(b, "n1")


def split_points(crossings: DataFrame, merge_distance: float = 1.0) -> DataFrame:
    """Split positions along each edge: ``edge_id, t, x, y, split_no``.

    Sorted along the edge; a point closer than the merge distance to the one
    before it is dropped.
    """
    both = crossings.select(F.col("a_id").alias("edge_id"), "t", "x", "y").unionByName(
        crossings.select(F.col("b_id").alias("edge_id"), F.col("u").alias("t"), "x", "y")
    )
    w = W.partitionBy("edge_id").orderBy("t", "x", "y")
    gap = (F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2
    kept = both.withColumn("_d", gap).where(F.col("_d").isNull() | (F.col("_d") >= merge_distance**2)).drop("_d")
    return kept.withColumn("split_no", F.row_number().over(W.partitionBy("edge_id").orderBy("t", "x", "y")))


def split_at_crossings(
    nodes: DataFrame, edges: DataFrame, cell: float = 1000.0, tolerance: float = SPLIT_TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Graph with edges split where they cross; only live edges are kept.

    A split point within the tolerance of a node uses that node; the others
    merge among themselves in edge and position order and become new nodes.
    """
    crossings = checkpointed(spatial.crossing_segments(edge_segments(nodes, edges), cell))
    splits = split_points(crossings)
    splits = checkpointed(
        dense_index(splits, [F.floor(F.col("edge_id") / 65536)], [F.col("edge_id"), F.col("split_no")], "probe_id")
    )
    reused = spatial.nearest_within(splits.select("probe_id", "x", "y"), nodes, tolerance)
    fresh = splits.join(reused.select("probe_id"), "probe_id", "left_anti")
    merged = merge_positions(fresh.select("x", "y", F.col("probe_id").alias("ord")), tolerance)
    leads = merged.where("ord = leader").select("ord", "x", "y")
    top = nodes.agg((F.coalesce(F.max("node_id"), F.lit(-1)) + 1).alias("_top")).withColumn("_k", F.lit(1))
    numbered = dense_index(leads, [F.floor(F.col("ord") / 65536)], [F.col("ord")], "_n").withColumn("_k", F.lit(1))
    made = checkpointed(
        numbered.join(F.broadcast(top), "_k").select(  # one row
            (F.col("_n") + F.col("_top")).alias("node_id"),
            "x",
            "y",
            (F.col("x") / UNITS_PER_DEGREE).alias("lon"),
            (F.col("y") / UNITS_PER_DEGREE).alias("lat"),
            F.col("ord").alias("leader"),
        )
    )
    from_new = merged.join(made.select("leader", "node_id"), "leader").select(F.col("ord").alias("probe_id"), "node_id")
    at = splits.join(reused.select("probe_id", "node_id").unionByName(from_new), "probe_id")
    stops = (
        at.select("edge_id", F.col("split_no").cast("long").alias("stop"), "node_id")
        .unionByName(edges.select("edge_id", F.lit(0).cast("long").alias("stop"), F.col("n0").alias("node_id")))
        .unionByName(edges.select("edge_id", F.lit(1 << 40).alias("stop"), F.col("n1").alias("node_id")))
    )
    w = W.partitionBy("edge_id").orderBy("stop")
    chain = stops.withColumn("n1", F.lead("node_id").over(w)).where("n1 IS NOT NULL AND n1 <> node_id")
    live = chain.join(edges.select("edge_id", "road_class"), "edge_id").select(
        F.col("edge_id").alias("source_edge_id"), "stop", F.col("node_id").alias("n0"), "n1", "road_class"
    )
    live = dense_index(
        live, [F.floor(F.col("source_edge_id") / 65536)], [F.col("source_edge_id"), F.col("stop")], "edge_id"
    )
    all_nodes = nodes.select("node_id", "x", "y", "lon", "lat").unionByName(made.drop("leader"))
    return all_nodes, live.select("edge_id", "n0", "n1", "road_class", "source_edge_id")


def edge_angles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge ends at each node with the angle they leave at."""
    seg = edge_segments(nodes, edges)
    out = seg.select(
        F.col("n0").alias("node_id"), F.col("seg_id").alias("edge_id"), F.lit(True).alias("leaves_forward"),
        F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("angle"),
    )
    back = seg.select(
        F.col("n1").alias("node_id"), F.col("seg_id").alias("edge_id"), F.lit(False).alias("leaves_forward"),
        F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")).alias("angle"),
    )
    return out.unionByName(back)


def leftmost_turns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Next edge after arriving by each edge: the next one by angle, cyclic.

    ``edge_id, forward`` is the arrival (forward ends at ``n1``); nodes with
    fewer than two edges give no turn.
    """
    ends = edge_angles(nodes, edges)
    w = W.partitionBy("node_id").orderBy("angle", "edge_id")
    whole = W.partitionBy("node_id").orderBy("angle", "edge_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pick = F.struct("edge_id", "leaves_forward")
    nxt = F.coalesce(F.lead(pick).over(w), F.first(pick).over(whole))
    return (
        ends.withColumns({"_n": nxt, "_deg": F.count(F.lit(1)).over(W.partitionBy("node_id"))})
        .where("_deg >= 2")
        .select(
            "node_id",
            "edge_id",
            (~F.col("leaves_forward")).alias("forward"),
            F.col("_n.edge_id").alias("next_edge_id"),
            F.col("_n.leaves_forward").alias("next_forward"),
        )
    )

