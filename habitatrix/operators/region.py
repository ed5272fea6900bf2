"""Point-in-region filter without geometry objects.

The map is covered by square cells.  A cell is inside a polygon, outside, or cut by some of its edges.
Only points in cut cells test edges, and only those of their own cell: the parity of the cell's corner
is known, and what an edge adds on the way from the corner up the left side and then across to the
point is counted.  One equi-join on the cell does it; the test runs as an array expression, so points
are neither multiplied nor shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from habitatrix.functions.geo import grid_cell
from habitatrix.session import BROADCAST_ROWS, lookup

#: Cells that cover the box around all polygons, and the least width of one.
MAX_CELLS = 40_000
LEAST_CELL_M = 200.0

#: Where the grid begins, so that round coordinates never lie on its lines.
_START = 0.3183098861837907


def cell_width(edges: DataFrame) -> float:
    """Width of the cells for this map: its box has at most about ``MAX_CELLS``."""
    box = edges.agg(
        (F.max(F.greatest("x1", "x2")) - F.min(F.least("x1", "x2"))).alias("w"),
        (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("h"),
    ).first()
    return max(LEAST_CELL_M, ((box.w or 0.0) * (box.h or 0.0) / MAX_CELLS) ** 0.5)


def _line(c: Column, width: float) -> Column:
    return c * F.lit(width) + F.lit(_START)


def _cell(c: Column, width: float) -> Column:
    return grid_cell(c - F.lit(_START), width)


def cell_cover(edges: DataFrame, width: float) -> DataFrame:
    """(row, col, whole, polygons): cells that a polygon covers or cuts.

    ``polygons`` has, for each polygon that cuts the cell, the parity of the cell's lower left corner and
    the polygon's edges in the cell.  The table grows with the map, never with the observations.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = F.sequence(_cell(low, width), _cell(high, width))
    spread = edges.select("poly_id", "x1", "y1", "x2", "y2", F.explode(rows).alias("row"))
    bottom = _line(F.col("row"), width)

    def at(y: Column) -> Column:
        return F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    enters, leaves = at(F.greatest(low, bottom)), at(F.least(high, bottom + F.lit(width)))
    flat = F.col("y1") == F.col("y2")
    first = F.when(flat, F.least("x1", "x2")).otherwise(F.least(enters, leaves)) - 1e-6
    last = F.when(flat, F.greatest("x1", "x2")).otherwise(F.greatest(enters, leaves)) + 1e-6
    cut = (
        spread.withColumn("col", F.explode(F.sequence(_cell(first, width), _cell(last, width))))
        .groupBy("row", "col", "poly_id")
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))
    )
    # corners between the first and second, third and fourth ... crossing of a row's lower line are inside
    crossing = spread.where((F.col("y1") > bottom) != (F.col("y2") > bottom)).select("row", "poly_id", at(bottom).alias("x"))
    per_line = Window.partitionBy("row", "poly_id").orderBy("x")
    runs = crossing.select("row", "poly_id", "x", F.lead("x").over(per_line).alias("to"), F.row_number().over(per_line).alias("n"))
    runs = runs.where("n % 2 = 1").select("row", "poly_id", (_cell(F.col("x"), width) + 1).alias("a"), _cell(F.col("to"), width).alias("b"))
    inside = runs.where("a <= b").select("row", "poly_id", F.explode(F.sequence("a", "b")).alias("col"))

    keys = ["row", "col", "poly_id"]
    parity = inside.withColumn("odd", F.lit(True))
    cells = cut.join(parity, keys, "left").select(
        "row", "col", F.struct(F.coalesce("odd", F.lit(False)).alias("odd"), "edges").alias("polygon")
    )
    whole = inside.join(cut, keys, "left_anti").select("row", "col").distinct().withColumn("whole", F.lit(True))
    listed = cells.groupBy("row", "col").agg(F.collect_list("polygon").alias("polygons"))
    return listed.join(whole, ["row", "col"], "full").select("row", "col", F.coalesce("whole", F.lit(False)).alias("whole"), "polygons")


def _side(e: Column, x: Column, y: Column) -> Column:
    """Sign tells on which side of the edge's line a point lies; zero is on it."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])


def _touches(e: Column, x: Column, y: Column) -> Column:
    return (
        (_side(e, x, y) == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def _passed(e: Column, left: Column, bottom: Column, x: Column, y: Column) -> Column:
    """Whether the way (left, bottom) - (left, y) - (x, y) crosses the edge an odd number of times.

    Both parts ask the same sign at their common point, so an edge through it counts once.
    """

    def above(py: Column) -> Column:  # where the edge meets the left side, seen from (left, py)
        s = _side(e, left, py)
        return F.when(e["x2"] > e["x1"], s < 0).otherwise(s > 0)

    def right_of(px: Column) -> Column:  # where the edge meets the level of the point
        s = _side(e, px, y)
        return F.when(e["y2"] > e["y1"], s > 0).otherwise(s < 0)

    upwards = ((e["x1"] > left) != (e["x2"] > left)) & above(bottom) & ~above(y)
    across = ((e["y1"] > y) != (e["y2"] > y)) & right_of(left) & ~right_of(x)
    return upwards != across


def in_region(
    points: DataFrame, edges: DataFrame, x: str = "E", y: str = "N", width: float | None = None
) -> DataFrame:
    """Keep points inside, or on the edge of, any polygon.

    Parity is taken per polygon, so overlaps need no dissolve and holes work.
    """
    width = cell_width(edges) if width is None else width
    index = cell_cover(edges, width)
    px, py = F.col(x), F.col(y)
    left, bottom = _line(F.col("_col"), width), _line(F.col("_row"), width)

    def covers(polygon: Column) -> Column:
        passed = F.size(F.filter(polygon["edges"], lambda e: _passed(e, left, bottom, px, py)))
        odd = (passed % 2 == 1) != polygon["odd"]
        return odd | F.exists(polygon["edges"], lambda e: _touches(e, px, py))

    tagged = points.withColumns({"_row": _cell(py, width), "_col": _cell(px, width)})
    named = index.withColumnsRenamed({"row": "_row", "col": "_col"})
    # a cell's arrays hold the edges of the map, so those count, not only the cells
    small = edges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (
        tagged.join(lookup(named, 2 * MAX_CELLS) if small else named, ["_row", "_col"], "inner")
        .where(F.col("whole") | F.coalesce(F.exists("polygons", covers), F.lit(False)))
        .select(*points.columns)
    )
