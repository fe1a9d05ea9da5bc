"""Planar geometry as column expressions over vertex arrays.

Arrays hold structs ``(lon, lat)`` or ``(x, y)``; ``fx``/``fy`` name the
fields. Rings may or may not repeat their first vertex; means count a repeated
closing vertex, as the data model defines them that way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARALLEL_EPS = 1e-4  # fixed tolerance of the intersection tests


def array_mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))


def vertex_mean(points: Column, fx: str, fy: str) -> Column:
    """Struct of the plain vertex mean; NULL for an empty array."""
    return F.when(
        F.size(points) > 0,
        F.struct(
            array_mean(F.transform(points, lambda p: p[fx])).alias(fx),
            array_mean(F.transform(points, lambda p: p[fy])).alias(fy),
        ),
    )


def feature_centroid(geom_type: Column, rings: Column, ring_is_outer: Column) -> Column:
    """Vertex mean of a feature: outer rings only, all parts together.

    An unsupported or empty geometry gives NULL, and callers reject the row.
    """
    outer = F.flatten(
        F.transform(
            F.filter(F.arrays_zip(rings.alias("r"), ring_is_outer.alias("o")), lambda z: z["o"]), lambda z: z["r"]
        )
    )
    return F.when(geom_type.isNotNull(), vertex_mean(outer, "lon", "lat"))


def bbox(points: Column, fx: str = "lon", fy: str = "lat") -> Column:
    """Struct ``(min_<fx>, min_<fy>, max_<fx>, max_<fy>)``; NULL when empty."""
    xs = F.transform(points, lambda p: p[fx])
    ys = F.transform(points, lambda p: p[fy])
    return F.when(
        F.size(points) > 0,
        F.struct(
            F.array_min(xs).alias(f"min_{fx}"),
            F.array_min(ys).alias(f"min_{fy}"),
            F.array_max(xs).alias(f"max_{fx}"),
            F.array_max(ys).alias(f"max_{fy}"),
        ),
    )


def feature_bbox(rings: Column) -> Column:
    """Bounding box over every ring of a feature, holes included."""
    return bbox(F.flatten(rings))


def _with_next(points: Column) -> Column:
    """Array of ``(a, b)`` edges of the closed ring."""
    rotated = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    return F.arrays_zip(points.alias("a"), rotated.alias("b"))


def signed_area(points: Column, fx: str = "x", fy: str = "y") -> Column:
    """Shoelace area, positive counter-clockwise, in squared input units."""
    doubled = F.aggregate(
        _with_next(points),
        F.lit(0.0),
        lambda acc, e: acc + e["a"][fx] * e["b"][fy] - e["b"][fx] * e["a"][fy],
    )
    return F.when(F.size(points) > 0, doubled / 2.0).otherwise(F.lit(0.0))


def area_sqm(points: Column) -> Column:
    """Area in m2 of a ring given in centimetres."""
    return F.abs(signed_area(points)) / 10000.0


def net_area_sqm(points: Column, holes: Column) -> Column:
    """Area in m2 of a ring without the areas of its holes."""
    return area_sqm(points) - F.aggregate(holes, F.lit(0.0), lambda acc, h: acc + area_sqm(h))


def is_clockwise(points: Column, fx: str = "x", fy: str = "y") -> Column:
    return signed_area(points, fx, fy) < 0.0


def edge_crosses_ray(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether the eastward ray from (px, py) crosses edge a-b (b before a)."""
    spans = (ay > py) != (by > py)
    return spans & (px < (bx - ax) * (py - ay) / (by - ay) + ax)


def point_in_polygon(px: Column, py: Column, points: Column, fx: str = "x", fy: str = "y") -> Column:
    """Even-odd test; fewer than three vertices is always outside."""
    previous = F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1))
    edges = F.arrays_zip(points.alias("a"), previous.alias("b"))
    hits = F.size(
        F.filter(edges, lambda e: edge_crosses_ray(px, py, e["a"][fx], e["a"][fy], e["b"][fx], e["b"][fy]))
    )
    return F.when(F.size(points) >= 3, hits % 2 == 1).otherwise(F.lit(False))


def _cross(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    return dx1 * dy2 - dy1 * dx2


def line_parameters(ax, ay, bx, by, cx, cy, dx, dy) -> tuple[Column, Column, Column]:
    """Parameters ``(t, u, denominator)`` of the meeting of lines a-b and c-d."""
    denom = _cross(bx - ax, by - ay, dx - cx, dy - cy)
    t = F.try_divide(_cross(cx - ax, cy - ay, dx - cx, dy - cy), denom)
    u = F.try_divide(_cross(cx - ax, cy - ay, bx - ax, by - ay), denom)
    return t, u, denom


def segment_intersection(ax, ay, bx, by, cx, cy, dx, dy, eps: float = PARALLEL_EPS) -> Column:
    """Struct ``(t, u)`` where segments meet within tolerance, else NULL."""
    t, u, denom = line_parameters(ax, ay, bx, by, cx, cy, dx, dy)
    inside = t.between(-eps, 1.0 + eps) & u.between(-eps, 1.0 + eps)
    return F.when((F.abs(denom) >= eps) & inside, F.struct(t.alias("t"), u.alias("u")))


def point_side_of_line(px, py, ax, ay, bx, by) -> Column:
    """Positive left of a->b, negative right, zero on the line."""
    return _cross(bx - ax, by - ay, px - ax, py - ay)


def explode_edges(df, ring: str, keep: list[str], fx: str = "x", fy: str = "y"):
    """One row per closed-ring edge: ``keep`` + ``edge_no, ax, ay, bx, by``.

    Edge ``i`` runs from vertex ``i`` (a) to its predecessor (b).
    """
    indexed = df.select(*keep, F.posexplode(ring).alias("edge_no", "_a"), F.col(ring).alias("_ring"))
    prev = F.element_at(
        "_ring", F.when(F.col("edge_no") == 0, F.size("_ring")).otherwise(F.col("edge_no")).cast("int")
    )
    return indexed.select(
        *keep,
        "edge_no",
        F.col("_a")[fx].alias("ax"),
        F.col("_a")[fy].alias("ay"),
        prev[fx].alias("bx"),
        prev[fy].alias("by"),
    )
