"""Lattice points inside polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions import geometry as G
from landloom.functions import tags as K
from landloom.operators import filters as Fl
from landloom.schema import LAND_USE_TYPES
from landloom.session import once

JITTER_PRIME = 16777213
FEW_EDGES, FEW_PLACES = 64, 1 << 16  # a polygon up to which no row of it is shuffled


def _jitter(seed: int, axis: str, amount: float) -> Column:
    """Uniform offset in [-amount, amount) from the lattice position.

    Whole-number arithmetic modulo a prime, the same in any engine.
    """
    start = F.lit(seed * 7919 + {"x": 104729, "y": 1299709}[axis]).cast("long")
    at = start + F.pmod(F.col("polygon_id"), F.lit(65521)) * 40503 + F.col("ix") * 2654435 + F.col("iy") * 97531
    at = F.pmod(at, F.lit(JITTER_PRIME))
    return ((F.pmod(at * at + at * 7, F.lit(JITTER_PRIME)) / float(JITTER_PRIME)) * 2.0 - 1.0) * float(amount)


def _edges(ring: Column) -> Column:
    """Edges ``ax, ay, bx, by`` of a closed ring, as one array; an edge runs from a vertex to its predecessor."""

    def edge(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, F.size(ring)).otherwise(i).cast("int"))
        return F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))

    return F.transform(ring, edge)


def _rows(polygons: DataFrame, cols: list[str], step: float, reach: float) -> DataFrame:
    """Each lattice row ``iy`` of a polygon with its ``near`` edges (within ``reach`` of the row), holes included.

    Polygons of few edges and few places are cut into rows where they are; only
    rows of the others are shuffled.
    """
    edges = _edges(F.col("world_vertices"))
    if "world_holes" in polygons.columns:
        edges = F.concat(edges, F.coalesce(F.flatten(F.transform("world_holes", _edges)), F.array().cast("array<struct<ax:double,ay:double,bx:double,by:double>>")))
    shapes = once(polygons.where((F.size("world_vertices") >= 3) & F.col("polygon_id").isNotNull()), edges=edges, b=G.bbox(F.col("world_vertices"), "x", "y"))
    shapes = shapes.select("polygon_id", *cols, "edges", "b.*")
    last_row = F.floor((F.col("max_y") - F.col("min_y")) / step)
    places = (last_row + 1.0) * (F.floor((F.col("max_x") - F.col("min_x")) / step) + 1.0)
    few = (F.size("edges") <= FEW_EDGES) & (places <= FEW_PLACES)

    def row(v: Column) -> Column:
        return (v - F.col("min_y")) / step

    def first(ay: Column, by: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil(row(F.least(ay, by) - reach) - 1e-6))

    def last(ay: Column, by: Column) -> Column:
        return F.least(last_row, F.floor(row(F.greatest(ay, by) + reach) + 1e-6))

    small = shapes.where(few).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), last_row)))
    at_row = lambda e: (first(e["ay"], e["by"]) <= F.col("iy")) & (last(e["ay"], e["by"]) >= F.col("iy"))
    carried = [*cols, "min_x", "max_x", "min_y"]
    small = small.select("polygon_id", "iy", *carried, F.filter("edges", at_row).alias("near"))
    large = shapes.where(~few).select("*", F.explode("edges").alias("e")).drop("edges")
    at = first(F.col("e.ay"), F.col("e.by")), last(F.col("e.ay"), F.col("e.by"))
    large = large.withColumn("iy", F.explode(F.when(at[0] <= at[1], F.sequence(*at)))).repartition("polygon_id", "iy").groupBy("polygon_id", "iy")
    large = large.agg(F.collect_list("e").alias("near"), *[F.first(c).alias(c) for c in carried])
    return small.unionByName(large)


def _filled_rows(rows: DataFrame, step: float) -> DataFrame:
    """Scan-line fill: a row's crossings, sorted, bound its runs in pairs; only points inside are made."""
    y = F.col("min_y") + F.col("iy") * step
    spans = F.filter("near", lambda e: (e["ay"] > y) != (e["by"] > y))
    crossing = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
    rows = once(rows, xs=F.array_sort(F.transform(spans, crossing))).drop("near")
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda k: F.struct(F.element_at("xs", k).alias("lo"), F.element_at("xs", k + 1).alias("hi")))
    runs = rows.where(F.size("xs") > 1).withColumn("run", F.explode(pairs)).drop("xs")
    column = lambda v: F.floor((v - F.col("min_x")) / step).cast("long")
    first = F.greatest(F.lit(0).cast("long"), column(F.col("run.lo")))
    last = F.least(column(F.col("max_x")), column(F.col("run.hi")) + 1)
    grid = runs.withColumn("ix", F.explode(F.when(first <= last, F.sequence(first, last))))
    grid = grid.withColumns({"x": F.col("min_x") + F.col("ix") * step, "y": y})
    return grid.where((F.col("x") >= F.col("run.lo")) & (F.col("x") < F.col("run.hi")))


def _tested_rows(rows: DataFrame, step: float, reach: float, seed: int) -> DataFrame:
    """Every point of a row, moved, and tested against the edges near the row."""
    columns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("max_x") - F.col("min_x")) / step))
    grid = rows.withColumn("ix", F.explode(columns))
    dx, dy = _jitter(seed, "x", reach), _jitter(seed, "y", reach)
    grid = grid.withColumns(
        {"x": F.col("min_x") + F.col("ix") * step + dx, "y": F.col("min_y") + F.col("iy") * step + dy}
    )
    hits = F.size(
        F.filter("near", lambda e: G.edge_crosses_ray(F.col("x"), F.col("y"), e["ax"], e["ay"], e["bx"], e["by"]))
    )
    return grid.where(hits % 2 == 1)


def lattice_points(polygons: DataFrame, interval_cm: float = 1000.0, jitter_cm: float = 0.0, seed: int = 42) -> DataFrame:
    """Points of a square lattice that fall inside each polygon and outside its ``world_holes``, if any.

    The lattice starts at the polygon's lowest x and y and includes the far
    edge. A random offset is derived from the lattice position, so results do
    not depend on execution order; the inside test follows the offset.

    Rows of a small polygon are made in its own row. Those of others are dealt
    out by polygon and row before columns are expanded, so a very large polygon
    is shared out row by row. Without an offset a row is
    filled between its sorted crossings, and no point outside is ever made;
    with one, each point of a row is tested against the edges near that row.
    """
    cols = [c for c in ("land_use", "building_density", "vegetation_density") if c in polygons.columns]
    step, reach = float(interval_cm), float(jitter_cm)
    rows = _rows(polygons, cols, step, reach)
    grid = _tested_rows(rows, step, reach, seed) if reach else _filled_rows(rows, step)
    return grid.select("polygon_id", *cols, "ix", "iy", "x", "y")


def sample_points(
    polygons: DataFrame,
    interval_m: float = 10.0,
    jitter_m: float | None = 2.0,
    seed: int = 42,
    types: list[str] | None = None,
    around: tuple[float, float] | None = None,
    tile_size_m: float = 1024.0,
    load_radius: int = 3,
) -> DataFrame:
    """Sample points with the attributes of their polygon.

    ``around`` restricts to polygons centred in the load radius of a world
    position; ``types`` to land-use types (empty means all).
    """
    df = polygons
    if around is not None:
        df = Fl.in_load_radius(df, around[0], around[1], tile_size_m, load_radius)
    df = Fl.by_land_use(df, types)
    points = lattice_points(df, interval_m * 100.0, (jitter_m or 0.0) * 100.0, seed)
    unknown = len(LAND_USE_TYPES) - 1
    return points.select(
        "polygon_id",
        "x",
        "y",
        F.lit(0.0).alias("z"),
        F.lit(1.0).alias("density"),
        F.xxhash64(F.lit(seed), "polygon_id", "ix", "iy").alias("seed"),
        F.coalesce(K.land_use_ordinal(F.col("land_use")), F.lit(unknown)).alias("land_use_type"),
        "building_density",
        "vegetation_density",
    )
