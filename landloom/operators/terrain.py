"""Slope, aspect and terrain class of raster cells.

A raster is a long table ``grid_id, x, y, elev`` with row 0 in the south.
Neighbours are read in square blocks with a rim of one cell: a raster of any
shape is dealt out by block, in one shuffle, and only a block's row or column is
ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landloom.functions import tags as K
from landloom.schema import TerrainConfig

GRID = "grid_id"


BLOCK = 512
_KEYS = ["_bx", "_by", "_own"]


def _blocks(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Cells dealt out by block; a cell on a block's rim goes to the blocks beside it, too (``_own`` false)."""

    def shifts(c: str):
        at = F.pmod(c, F.lit(block))
        return F.array_compact(F.array(F.lit(0), F.when(at == 0, -1), F.when(at == block - 1, 1)))

    spread = cells.withColumn("_sx", F.explode(shifts("x"))).withColumn("_sy", F.explode(shifts("y")))
    spread = spread.withColumns(
        {
            "_bx": F.floor(F.col("x") / block) + F.col("_sx"),
            "_by": F.floor(F.col("y") / block) + F.col("_sy"),
            "_own": (F.col("_sx") == 0) & (F.col("_sy") == 0),
        }
    )
    return spread.drop("_sx", "_sy").repartition(GRID, "_bx", "_by")


def _row():
    return W.partitionBy(GRID, "_bx", "_by", "y").orderBy("x")


def _column():
    return W.partitionBy(GRID, "_bx", "_by", "x").orderBy("y")


def gradients(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the 3x3 weighted differences ``gx, gy`` (edge cells repeat).

    The 3x3 kernel is separable, so two one-dimensional passes replace nine
    neighbour look-ups: along a row for the difference and the weighted sum,
    then along a column for the weighted sum and the difference.
    """
    left = F.coalesce(F.lag("elev").over(_row()), F.col("elev"))
    right = F.coalesce(F.lead("elev").over(_row()), F.col("elev"))
    across = _blocks(cells, block).withColumns({"_dx": right - left, "_sx": left + 2.0 * F.col("elev") + right})

    def before(c):
        return F.coalesce(F.lag(c).over(_column()), F.col(c))

    def after(c):
        return F.coalesce(F.lead(c).over(_column()), F.col(c))

    return across.withColumns(
        {
            "gx": before("_dx") + 2.0 * F.col("_dx") + after("_dx"),
            "gy": after("_sx") - before("_sx"),
        }
    ).where("_own").drop("_dx", "_sx", *_KEYS)


def slope_aspect(cells: DataFrame, cell_size_m: float = 30.0) -> DataFrame:
    """Add ``slope`` and ``aspect`` in degrees, and ``compass_aspect``.

    ``aspect`` is atan2(gy, -gx) mapped to 0..360; ``compass_aspect`` is the
    downslope direction clockwise from north. Needs at least 3 x 3 cells.
    """
    g = gradients(cells)
    scale = 8.0 * float(cell_size_m)
    dzdx, dzdy = F.col("gx") / scale, F.col("gy") / scale
    raw = F.degrees(F.atan2(F.col("gy"), -F.col("gx")))
    compass = F.degrees(F.atan2(-F.col("gx"), -F.col("gy")))
    return g.withColumns(
        {
            "slope": F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy))),
            "aspect": F.when(raw < 0.0, raw + 360.0).otherwise(raw),
            "compass_aspect": F.when(compass < 0.0, compass + 360.0).otherwise(compass),
        }
    ).drop("gx", "gy")


def classify_cells(cells: DataFrame, cfg: TerrainConfig = TerrainConfig(), parity_nodata: bool = False) -> DataFrame:
    """Add ``terrain_class``; cells without elevation are left out.

    ``parity_nodata`` keeps them and classifies the sentinel value instead.
    """
    df = cells if parity_nodata else cells.where("elev IS NOT NULL")
    return df.withColumn("terrain_class", K.terrain_class(F.col("elev"), F.col("slope"), cfg))


def slope_grid(cells: DataFrame) -> DataFrame:
    return cells.select(GRID, "x", "y", "slope")


def class_grid(cells: DataFrame) -> DataFrame:
    return cells.select(GRID, "x", "y", "terrain_class")


def with_neighbours(cells: DataFrame, column: str, block: int = BLOCK) -> DataFrame:
    """Add ``n_left, n_right, n_up, n_down``: the column at the 4 neighbours.

    NULL where there is no neighbour. ``up`` is y-1 and ``down`` y+1.
    """

    def at(fn, window, axis, step):
        return F.when(fn(axis).over(window) == F.col(axis) + step, fn(column).over(window))

    beside = _blocks(cells, block).withColumns(
        {
            "n_left": at(F.lag, _row(), "x", -1),
            "n_right": at(F.lead, _row(), "x", 1),
        }
    ).withColumns(
        {
            "n_up": at(F.lag, _column(), "y", -1),
            "n_down": at(F.lead, _column(), "y", 1),
        }
    )
    return beside.where("_own").drop(*_KEYS)


def flag_border_cells(cells: DataFrame, zone: str = "zone_id") -> DataFrame:
    """Add ``is_border``: a 4-neighbour is missing or in another zone."""
    df = with_neighbours(cells, zone)
    border = F.lit(False)
    for n in ("n_left", "n_right", "n_up", "n_down"):
        border = border | ~F.col(n).eqNullSafe(F.col(zone))
    return df.withColumn("is_border", border).drop("n_left", "n_right", "n_up", "n_down")
