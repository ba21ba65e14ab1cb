"""Nearest road from cells that were written once.

A batch join explodes the pieces into cells each time it runs. Where small batches
of points keep coming, the pieces are listed under their cells once, for every
radius, and written by tile: a tile is a hash of a square of neighbouring cells,
so the points of a batch name a few tiles and the other ones stay closed. Cells are
several radii wide, so that a piece is listed a few times only; points and pieces of a cell
meet in blocks (``operators/blocks.py``), which make no pairs that lose.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.functions.geo import piece_distance
from corridor_spark.operators.nearest import (
    BLOCK_PAIRS, BLOCK_SIDE, LOCAL, Metric, best_of, block_sizes, largest_latitude, met_in_blocks, placed_pieces, spread_pieces, with_cells)
from corridor_spark.session import small_side, stage

#: Cells along a side of the square that goes to one tile, and the number of tiles of a radius.
SIDE, TILES = 16, 128
#: The side in indexes that do not name theirs.
UNNAMED_SIDE = 64
#: Most cells with points whose list is sent to the tasks that read the tiles; a batch of so many points has no more.
BATCH_POINTS = 100_000


@dataclass(frozen=True)
class CellIndex:
    """A written index: where it is, radius and cell size of each of its steps, and its columns."""

    path: str
    steps: tuple[tuple[float, float, float], ...]
    tiles: int
    columns: str
    metric: Metric = LOCAL
    side: int = SIDE


def _tile(tiles: int, side: int) -> Column:
    return F.pmod(F.xxhash64(F.floor(F.col("_cx") / side), F.floor(F.col("_cy") / side)), F.lit(tiles)).cast("int")


def write_cells(pieces: DataFrame, path: str, radii_m: Sequence[float], attributes: Sequence[str],
                metric: Metric = LOCAL, tiles: int = TILES) -> CellIndex:
    """List the pieces under the cells (``BLOCK_SIDE`` radii wide) that their box, grown by each radius, touches.

    ``attributes`` hold the column that decides ties, too. The cells suit points of any latitude from which a piece can be reached; a point beyond
    has no road in a radius anyway. A tile with many pieces is written by several tasks.
    """
    pieces = placed_pieces(pieces)
    top = 0.0 if metric.planar else largest_latitude(pieces.select(F.greatest(F.abs("ay"), F.abs("by_")).alias("y")))
    steps, cells = [], None
    for number, radius in enumerate(radii_m):
        rx, ry = metric.reach(radius, top if metric.planar else top + radius / metric.lat_m)
        steps.append((float(radius), rx * BLOCK_SIDE, ry * BLOCK_SIDE))
        rows = spread_pieces(pieces.select("ax", "ay", "bx", "by_", *attributes), rx, ry, BLOCK_SIDE).withColumns(
            {"step": F.lit(number), "tile": _tile(tiles, SIDE)})
        cells = rows if cells is None else cells.unionByName(rows)
    cells.hint("rebalance", F.col("step"), F.col("tile")).sortWithinPartitions("step", "tile", "_cx", "_cy").write.mode(
        "overwrite").partitionBy("step", "tile").parquet(f"{path}/cells")
    columns = ", ".join(f"`{name}` {kind}" for name, kind in cells.dtypes)
    pieces.sparkSession.createDataFrame(
        [(n, *s, tiles, columns, SIDE) for n, s in enumerate(steps)],
        "step int, radius double, rx double, ry double, tiles int, columns string, side int"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")
    return CellIndex(path, tuple(steps), tiles, columns, metric)


def open_cells(spark: SparkSession, path: str, metric: Metric = LOCAL) -> CellIndex:
    """An index written earlier, for instance before a stream was started again."""
    steps = spark.read.parquet(f"{path}/steps").orderBy("step").collect()  # one row a radius
    return CellIndex(path, tuple((s["radius"], s["rx"], s["ry"]) for s in steps), steps[0]["tiles"], steps[0]["columns"], metric,
                     steps[0].asDict().get("side", UNNAMED_SIDE))


def nearest_indexed(points: DataFrame, index: CellIndex, attributes: Sequence[str], order: str = "way_id",
                    batch_points: int = BATCH_POINTS, cell_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``nearest`` against a written index: ``point_id, distance_m`` and the attributes of the winning piece.

    Up to ``batch_points`` cells with points go as a list to the tasks that read the tiles, and only the
    tiles that hold a point are opened. Points and the pieces of their cells meet in blocks of bounded size.
    """
    attributes, spark = list(attributes), points.sparkSession
    left = stage(points.select("point_id", "x", "y"), "points")
    cells, on = spark.read.schema(index.columns).parquet(f"{index.path}/cells"), ["tile", "_cx", "_cy"]
    carry = list(dict.fromkeys(["ax", "ay", "bx", "by_", order, *attributes]))
    found = None
    for number, (radius, rx, ry) in enumerate(index.steps):
        finite = left.filter(F.abs(F.col("x")) + F.abs(F.col("y")) < float("inf"))  # other points have no cell
        located = with_cells(finite, rx, ry).withColumn("tile", _tile(index.tiles, index.side))
        held = stage(located.groupBy(*on).agg(F.count(F.lit(1)).alias("n")), "held-cells")
        listed = cells.filter(F.col("step") == number).drop("step").join(
            small_side(held.where("n > 0").select(*on), batch_points), on, "left_semi")
        sizes = block_sizes(located, listed, on, max(1, math.isqrt(cell_pairs)))
        kx, ky = index.metric.scales(F.col("y"))
        pairs = met_in_blocks(located, listed, sizes, on, radius, index.metric, order, carry).withColumn("distance_m", piece_distance(
            F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), kx, ky)).filter(F.col("distance_m") <= radius)
        best = best_of(pairs, ["point_id"], attributes, order)
        if number + 1 < len(index.steps):
            best = stage(best, "nearest")
            left = stage(left.join(best.select("point_id"), "point_id", "left_anti"), "left")
        found = best if found is None else found.unionByName(best)
        if number + 1 < len(index.steps) and left.isEmpty():
            break
    return found
