"""Nearest piece at any distance, by a pyramid of occupied cells.

Every piece has one cell, that of its middle, at the finest resolution; coarser
levels are the same cells with fewer bits, four to one along each axis. A cell
holds the box around its pieces, one point of one of them, and their number. A
place starts at the top cell and goes down level by level: the box says how near
the cell's pieces can be at best, box and point how far the nearest is at most,
and a cell stays only while its best is within the least of those bounds. So a
place meets a few cells of each level however far away it lies, and only the
pieces of the last cells are measured. The descent ends at the first level whose
cells hold at most ``LEAF`` pieces.

Equal places go down once. Levels are small tables, and are sent to the tasks
only behind a count; else they are joined by their cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.functions.geo import foot_point, piece_distance
from corridor_spark.session import small_side, stage

#: Most pieces of a cell at which the descent ends, and the bits of the finest cells.
LEAF, BITS = 256, 24
#: Rounding slack of the bounds in metres, above the micrometre that decides ties.
SLACK = 1e-4


@dataclass
class Pyramid:
    """Pieces with their finest cell (``_ix, _iy``), the levels from the top down, and the last level's shift."""

    pieces: DataFrame
    levels: list[DataFrame]
    shift: int
    keys: list[str]


def _coarse(shift: int) -> list[Column]:
    return [F.shiftright("_ix", shift).alias("_cx"), F.shiftright("_iy", shift).alias("_cy")]


def build(pieces: DataFrame, keys: Sequence[str] = (), leaf: int = LEAF) -> Pyramid | None:
    """Pyramid over ``ax, ay, bx, by_``, one per value of ``keys``; None without pieces."""
    keys = list(keys)
    usable = pieces.where("ax is not null and ay is not null and bx is not null and by_ is not null")
    low_x, high_x, low_y, high_y = usable.agg(*(f(m) for m in (F.expr("(ax + bx) / 2"), F.expr("(ay + by_) / 2")) for f in (F.min, F.max))).first()
    if low_x is None:
        return None
    width = max(high_x - low_x, high_y - low_y) or 1.0

    def place(a: str, b: str, low: float) -> Column:
        share = ((F.col(a) + F.col(b)) / 2 - low) / width
        return F.least(F.floor(share * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("int")

    held = stage(usable.select("*", place("ax", "bx", low_x).alias("_ix"), place("ay", "by_", low_y).alias("_iy")), "pyramid-pieces")
    base = stage(held.groupBy(*keys, "_ix", "_iy").agg(
        F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"),
        F.min(F.least("ay", "by_")).alias("y0"), F.max(F.greatest("ay", "by_")).alias("y1"),
        F.min(F.struct("ax", "ay")).alias("some"), F.count(F.lit(1)).alias("held")), "pyramid-base")
    levels = []
    for shift in range(BITS, -1, -2):
        level = stage(base.groupBy(*keys, *_coarse(shift)).agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"),
            F.min("some").alias("some"), F.sum("held").alias("held")), "pyramid-level")
        levels.append(level)
        if (level.agg(F.max("held")).first()[0] or 0) <= leaf:
            break
    return Pyramid(held, levels, shift, keys)


def _bounds(kx: Column, ky: Column) -> tuple[Column, Column]:
    """Least distance of the row's place to the box, and most to the nearest piece in it."""
    x, y = F.col("x"), F.col("y")
    best = F.hypot(F.greatest(F.col("x0") - x, x - F.col("x1"), F.lit(0.0)) * kx, F.greatest(F.col("y0") - y, y - F.col("y1"), F.lit(0.0)) * ky)
    corner = F.hypot(F.greatest(F.abs(x - F.col("x0")), F.abs(x - F.col("x1"))) * kx, F.greatest(F.abs(y - F.col("y0")), F.abs(y - F.col("y1"))) * ky)
    return best, F.least(corner, F.hypot((x - F.col("some.ax")) * kx, (y - F.col("some.ay")) * ky))


def cells_in_reach(places: DataFrame, pyramid: Pyramid, metric) -> DataFrame:
    """``_place``, ``x, y``, keys and ``_cx, _cy``: the last level's cells that can hold a place's nearest piece."""
    keys, kx_ky = pyramid.keys, metric.scales(F.col("y"))
    best, most = _bounds(*kx_ky)
    near = places
    for depth, level in enumerate(pyramid.levels):
        side = level.select(*keys, F.shiftright("_cx", 2).alias("_px"), F.shiftright("_cy", 2).alias("_py"), F.col("_cx").alias("_nx"),
                            F.col("_cy").alias("_ny"), "x0", "x1", "y0", "y1", "some")
        if not depth:
            near = near.withColumns({"_cx": F.lit(0), "_cy": F.lit(0)})  # the top is one cell
        on = [*keys, "_px", "_py"]
        met = near.withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).join(small_side(side), on).select(
            "_place", "x", "y", *keys, F.col("_nx").alias("_cx"), F.col("_ny").alias("_cy"), best.alias("_best"), most.alias("_most"))
        reach = F.min("_most").over(Window.partitionBy("_place"))
        near = met.withColumn("_reach", reach).where(F.col("_best") <= F.col("_reach") * (1 + 1e-9) + SLACK).drop("_best", "_most", "_reach")
    return near


def nearest_anywhere(points: DataFrame, pieces: DataFrame, attributes: Sequence[str], metric, keys: Sequence[str] = (),
                     order: str = "way_id", foot: bool = False, leaf: int = LEAF) -> DataFrame:
    """``point_id, distance_m`` and the attributes of the nearest piece, at any distance.

    ``points`` has ``point_id, x, y`` and ``keys``; a point whose keys no piece
    has is left out. Distances equal to the micrometre go to the smallest ``order``.
    """
    keys, attributes = list(keys), list(attributes)
    pyramid = build(pieces.select(*dict.fromkeys(["ax", "ay", "bx", "by_", *keys, order, *attributes])), keys, leaf)
    if pyramid is None:
        none = {"distance_m": "double", **{a: pieces.schema[a].dataType for a in attributes}, **({"foot": "struct<x: double, y: double>"} if foot else {})}
        return points.limit(0).select("point_id", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    return descend(points, pyramid, attributes, metric, order, foot)


def descend(points: DataFrame, pyramid: Pyramid, attributes: Sequence[str], metric, order: str = "way_id", foot: bool = False) -> DataFrame:
    """``nearest_anywhere`` over a pyramid that was built before, so that many batches of points share it."""
    keys, payload = pyramid.keys, [*attributes, *(["foot"] if foot else [])]
    located = points.where("x is not null and y is not null").select("point_id", "x", "y", *keys).withColumn(
        "_place", F.xxhash64("x", "y", *keys))
    places = located.dropDuplicates(["_place", "x", "y", *keys]).drop("point_id")
    cells = stage(cells_in_reach(places, pyramid, metric), "pyramid-reach")
    leaves = pyramid.pieces.select("*", *_coarse(pyramid.shift))
    on = [*keys, "_cx", "_cy"]
    kx, ky = metric.scales(F.col("y"))
    wanted = leaves.join(small_side(cells.select(*on).distinct()), on, "left_semi")
    ends = [F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by_")]
    met = cells.join(wanted, on).withColumn("distance_m", piece_distance(*ends, kx, ky))
    if foot:
        met = met.withColumn("foot", foot_point(*ends, kx, ky))
    micrometres = F.floor(F.col("distance_m") * 1e6 + 0.5).alias("_um")
    best = met.groupBy("_place", "x", "y", *keys).agg(
        F.min(F.struct(micrometres, order, "distance_m", *[a for a in payload if a != order])).alias("_b"))
    return located.join(best, ["_place", "x", "y", *keys]).select("point_id", "_b.distance_m", *[f"_b.{a}" for a in payload])
