"""Land-cover rasters: windows, votes, crops.

Pixels are ``tile_col, tile_row, x, y, code``; ``grids`` has one row per raster
with ``width, height`` and its geographic bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom import schema as S
from landloom.functions import geometry as G
from landloom.functions import tags as K

TILE = ["tile_col", "tile_row"]
WINDOW = ["c0", "c1", "r0", "r1"]
# Land-use types a raster can vote for, in ordinal order (ties: lowest first).
VOTE_TYPES = tuple(t for t in S.LAND_USE_TYPES if t in set(S.WORLDCOVER_LAND_USE.values()))


def pixel_window(polygons: DataFrame, grids: DataFrame, row_origin: str = "north") -> DataFrame:
    """Pixel range ``c0, c1, r0, r1`` of each polygon row's bounding box in its tile's raster.

    Ranges are clamped to the raster. ``row_origin`` says where row 0 lies:
    ``north`` is how rasters are written, ``south`` reads them upside down.
    """
    return _with_window(polygons, grids, row_origin).select("polygon_id", *TILE, *WINDOW)


def _with_window(polygons: DataFrame, grids: DataFrame, row_origin: str) -> DataFrame:
    """Polygon rows that have a raster, with their pixel range."""
    if row_origin not in ("north", "south"):
        raise ValueError("row_origin must be 'north' or 'south'")
    box = polygons.where(F.size("geo_vertices") > 0).withColumn("_b", G.bbox(F.col("geo_vertices")))
    g = grids.select(*TILE, "width", "height", "min_lon", "min_lat", "max_lon", "max_lat").where(
        "width > 0 AND height > 0 AND max_lon > min_lon AND max_lat > min_lat"
    )
    joined = box.join(g, TILE)
    cw = (F.col("max_lon") - F.col("min_lon")) / F.col("width")
    ch = (F.col("max_lat") - F.col("min_lat")) / F.col("height")

    def clamp(v: Column, n: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), F.col(n) - 1))

    lo = clamp((F.col("_b.min_lat") - F.col("min_lat")) / ch, "height")
    hi = clamp((F.col("_b.max_lat") - F.col("min_lat")) / ch, "height")
    if row_origin == "north":
        lo, hi = F.col("height") - 1 - hi, F.col("height") - 1 - lo
    return joined.select(
        *polygons.columns,
        clamp((F.col("_b.min_lon") - F.col("min_lon")) / cw, "width").alias("c0"),
        clamp((F.col("_b.max_lon") - F.col("min_lon")) / cw, "width").alias("c1"),
        lo.alias("r0"),
        hi.alias("r1"),
    )


def running_counts(pixels: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Counts of each group over all pixels at or before (x, y), per raster.

    Two running sums, along a raster row and then along a raster column; no
    window ever holds more than one row or column of one raster.
    """
    flags = pixels.select(*TILE, "x", "y", *[c.cast("long").alias(n) for n, c in groups.items()])
    along_x = W.partitionBy(*TILE, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    along_y = W.partitionBy(*TILE, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    rows = flags.withColumns({n: F.sum(n).over(along_x) for n in groups})
    return rows.withColumns({n: F.sum(n).over(along_y) for n in groups})


def window_counts(windows: DataFrame, pixels: DataFrame, groups: dict[str, Column], key: list[str]) -> DataFrame:
    """Counts of each group in each window ``[c0, c1] x [r0, r1]``.

    Every window reads four corners of the running counts, so its cost does not
    depend on its size nor on how many windows overlap.
    """
    corners = F.array(
        *[
            F.struct(F.lit(s).alias("sign"), x.alias("x"), y.alias("y"))
            for s, x, y in (
                (1, F.col("c1"), F.col("r1")),
                (-1, F.col("c0") - 1, F.col("r1")),
                (-1, F.col("c1"), F.col("r0") - 1),
                (1, F.col("c0") - 1, F.col("r0") - 1),
            )
        ]
    )
    own = list(dict.fromkeys([*key, *TILE]))
    wanted = windows.select(*own, F.explode(corners).alias("_c")).select(*own, "_c.*")
    wanted = wanted.where("x >= 0 AND y >= 0")
    got = wanted.join(running_counts(pixels, groups), [*TILE, "x", "y"])
    return got.groupBy(*key).agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in groups])


def polygon_votes(polygons: DataFrame, pixels: DataFrame, grids: DataFrame, row_origin: str = "north") -> DataFrame:
    """Per polygon row ``polygon_id``, tile, votes per type, ``total_votes`` and ``winner``.

    Most votes win, the lowest type ordinal on ties; water wins as soon as it
    has more than a third of the votes. Polygons without votes are absent; a
    polygon kept by two tiles has a row for each.
    """
    windows = pixel_window(polygons, grids, row_origin)
    return windows.join(_window_votes(windows, pixels), [*TILE, *WINDOW]).drop(*WINDOW)


def _window_votes(windows: DataFrame, pixels: DataFrame) -> DataFrame:
    """Votes and winner per distinct window: they depend on the tile and the window alone."""
    voted = K.worldcover_to_land_use(F.col("code"))
    groups = {f"v_{t}": voted == t for t in VOTE_TYPES}
    distinct = windows.select(*TILE, *WINDOW).distinct()
    counts = window_counts(distinct, pixels, groups, [*TILE, *WINDOW])
    total = sum((F.col(n) for n in groups), F.lit(0))
    counts = counts.withColumn("total_votes", total.cast("long")).where("total_votes > 0")
    best = F.greatest(*[F.col(n) for n in groups])
    most = F.coalesce(*[F.when(F.col(f"v_{t}") == best, F.lit(t)) for t in VOTE_TYPES])
    winner = F.when(F.col("v_Water") > F.floor(F.col("total_votes") / 3), "Water").otherwise(most)
    return counts.withColumn("winner", winner)


def fuse_landcover(polygons: DataFrame, pixels: DataFrame, grids: DataFrame, row_origin: str = "north") -> DataFrame:
    """Replace ``land_use`` by the raster's winner; no votes leave it as it is.

    Rows meet the votes of their window in their own tile, so ids may be null
    and may occur in several tiles. Rows without a raster pass unchanged.
    """
    placed = _with_window(polygons, grids, row_origin)
    votes = _window_votes(placed, pixels).select(*TILE, *WINDOW, "winner")
    fused = placed.join(votes, [*TILE, *WINDOW], "left").withColumn("land_use", F.coalesce("winner", "land_use"))
    usable = grids.where("width > 0 AND height > 0 AND max_lon > min_lon AND max_lat > min_lat").select(*TILE).distinct()
    has_shape = F.coalesce(F.size("geo_vertices") > 0, F.lit(False))
    rest = polygons.where(has_shape).join(usable, TILE, "left_anti").unionByName(polygons.where(~has_shape))
    return fused.select(*polygons.columns).unionByName(rest.select(*polygons.columns))


def majority_class(pixels: DataFrame, start_col: int, start_row: int, region_w: int, region_h: int) -> DataFrame:
    """Most frequent non-zero code per raster in a window clipped to it.

    A raster whose window holds no data gives 0; ties go to the lowest code.
    """
    inside = (
        (F.col("x") >= max(0, start_col))
        & (F.col("x") < start_col + region_w)
        & (F.col("y") >= max(0, start_row))
        & (F.col("y") < start_row + region_h)
        & (F.col("code") > 0)
    )
    per_code = pixels.groupBy(*TILE, F.when(inside, F.col("code")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.when(F.col("code").isNotNull(), F.struct("n", (-F.col("code")).alias("c")))
    return per_code.groupBy(*TILE).agg(F.coalesce(F.max_by("code", rank), F.lit(0)).cast("int").alias("majority"))


def crop_to_tiles(tiles: DataFrame, pixels: DataFrame, transform, width: int, height: int) -> DataFrame:
    """Cut one raster into per-tile rasters (row 0 in the north).

    ``pixels`` is ``x, y, code`` of the whole raster and ``transform`` its
    (origin x, pixel width, 0, origin y, 0, pixel height) with a negative pixel
    height. Window limits truncate towards zero, are clamped to the raster, and
    exclude their end. Tiles with an empty window give no rows.

    Tiles and pixels meet on square pixel blocks, an equi-join.
    """
    x0, dx, y0, dy = float(transform[0]), float(transform[1]), float(transform[3]), float(transform[5])

    def clamp(v: Column, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(n - 1)))

    win = tiles.select(
        *TILE,
        clamp((F.col("min_lon") - x0) / dx, width).alias("c0"),
        clamp((F.col("max_lon") - x0) / dx, width).alias("c1"),
        clamp((F.col("max_lat") - y0) / dy, height).alias("r0"),
        clamp((F.col("min_lat") - y0) / dy, height).alias("r1"),
        "min_lat",
        "max_lat",
    ).where("c1 > c0 AND r1 > r0")
    block = 64

    def blocks(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))

    keyed = win.withColumn("bx", F.explode(blocks("c0", "c1"))).withColumn("by", F.explode(blocks("r0", "r1")))
    px = pixels.select("x", "y", "code").withColumns({"bx": F.floor(F.col("x") / block), "by": F.floor(F.col("y") / block)})
    hit = (F.col("x") >= F.col("c0")) & (F.col("x") < F.col("c1")) & (F.col("y") >= F.col("r0")) & (F.col("y") < F.col("r1"))
    return keyed.join(px, ["bx", "by"]).where(hit).select(
        *TILE,
        (F.col("c1") - F.col("c0")).alias("width"),
        (F.col("r1") - F.col("r0")).alias("height"),
        (F.col("x") - F.col("c0")).alias("x"),
        (F.col("y") - F.col("r0")).alias("y"),
        "code",
    )


def placeholder_landcover(tiles: DataFrame, size: int = 10, code: int = 30) -> DataFrame:
    """A uniform grassland raster per tile, for runs without any raster."""
    cells = F.sequence(F.lit(0), F.lit(size * size - 1))
    return tiles.select(*TILE, F.explode(cells).alias("_i")).select(
        *TILE,
        F.lit(size).alias("width"),
        F.lit(size).alias("height"),
        (F.col("_i") % size).cast("int").alias("x"),
        F.floor(F.col("_i") / size).cast("int").alias("y"),
        F.lit(code).alias("code"),
    )
