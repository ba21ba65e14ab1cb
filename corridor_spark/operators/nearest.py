"""Exact nearest-road joins over grid cells.

Pieces (two-point parts of roads) are listed in every cell their box, grown by
the search radius, touches; a point has one cell. Points and pieces of a cell
come together in blocks of bounded size, and inside a block a point is measured
only against the pieces around it (``operators/blocks.py``): pairs that cannot
win are never made, so twice the points and pieces are little more than twice
the work. The winners alone take up the attributes.

Cells are counted first: a crowded one is split into parts of its points and
shares of its pieces, and every part meets every share. Splitting changes the
work, not the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.functions.geo import foot_point, line_pieces, piece_distance
from corridor_spark.operators.blocks import k_winners, winners
from corridor_spark.operators.pyramid import nearest_anywhere
from corridor_spark.session import small_side, stage

#: Point-piece pairs of one cell that one task takes.
CELL_PAIRS = 20_000_000
#: Points times pieces that one block may hold (its square root bounds either), and the side of its cell in search radii.
BLOCK_PAIRS, BLOCK_SIDE = 2_500_000_000, 4.0
#: The same side where a block is made of whole cells.
SIDE_CELLS = int(BLOCK_SIDE)


@dataclass(frozen=True)
class Metric:
    """Metres per coordinate unit: ``lat_m`` north, ``lon_m``·cos(latitude) east (planar when ``planar``)."""

    lat_m: float = 111_320.0
    lon_m: float = 111_320.0
    planar: bool = False

    def scales(self, lat: Column) -> tuple[Column, Column]:
        if self.planar:
            return F.lit(1.0), F.lit(1.0)
        return F.lit(self.lon_m) * F.cos(F.radians(lat)), F.lit(self.lat_m)

    def reach(self, radius_m: float, max_lat: float) -> tuple[float, float]:
        """Radius in units along x and y; never smaller than the true reach up to latitude ``max_lat``."""
        if self.planar:
            return radius_m, radius_m
        shrink = max(math.cos(math.radians(min(abs(max_lat), 90.0))), 1e-9)
        return min(radius_m / (self.lon_m * shrink), 720.0), radius_m / self.lat_m


LOCAL = Metric()
NAMED = Metric(lat_m=110_574.0)
SPHERE = Metric(lat_m=6_371_000.0 * math.pi / 180, lon_m=6_371_000.0 * math.pi / 180)
PLANAR = Metric(planar=True)


def _crowded(located: DataFrame, spread: DataFrame, on: list[str], limit: int) -> DataFrame:
    """Parts into which each cell with more than ``limit`` pairs is split."""
    points, pieces = (df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((located, "n"), (spread, "m")))
    return points.join(pieces, on).filter(F.col("n") * F.col("m") > limit).select(
        *on, F.least("n", 1 + F.floor(F.col("n") * F.col("m") / limit)).cast("long").alias("_parts"))


def _cell(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(size)).cast("long")


def with_cells(points: DataFrame, rx: float, ry: float) -> DataFrame:
    """Points with their cell; points without coordinates are left out."""
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns(
        {"_cx": _cell(F.col("x"), rx), "_cy": _cell(F.col("y"), ry)}
    )


def placed_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces whose two ends are numbers; the others are near nothing."""
    return pieces.where(sum((F.abs(c) for c in ("ay", "bx", "by_")), F.abs("ax")) < float("inf"))


def spread_pieces(pieces: DataFrame, rx: float, ry: float, side: float = 1.0) -> DataFrame:
    """Pieces listed in every cell (``side`` reaches wide) that their box, grown by the reach, touches."""
    sx, sy = rx * side, ry * side
    return pieces.withColumn(
        "_cx", F.explode(F.sequence(_cell(F.least("ax", "bx") - rx, sx), _cell(F.greatest("ax", "bx") + rx, sx)))
    ).withColumn(
        "_cy", F.explode(F.sequence(_cell(F.least("ay", "by_") - ry, sy), _cell(F.greatest("ay", "by_") + ry, sy)))
    )


def with_salts(located: DataFrame, spread: DataFrame, on: list[str], cell_pairs: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and their join columns, the points of crowded cells split and those cells' pieces repeated."""
    salts = stage(_crowded(located, spread, on, cell_pairs), "crowded")
    if salts.isEmpty():
        return located, spread, on
    salts = small_side(salts)
    located = located.join(salts, on, "left").withColumn(
        "_salt", F.pmod(F.xxhash64("point_id"), F.coalesce("_parts", F.lit(1))).cast("long")
    ).drop("_parts")
    spread = spread.join(salts, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
    ).drop("_parts")
    return located, spread, [*on, "_salt"]


def best_of(pairs: DataFrame, group: Sequence[str], payload: Sequence[str], order: str) -> DataFrame:
    """Winning pair of each point: smallest distance to the micrometre, then smallest ``order``."""
    return (
        pairs.groupBy(*group)
        .agg(F.min(F.struct(_micrometres(), order, "distance_m", *[a for a in payload if a != order])).alias("_b"))
        .select("point_id", "_b.distance_m", *[f"_b.{a}" for a in payload])
    )


def largest_latitude(points: DataFrame) -> float:
    """Largest absolute ``y`` of the points: how narrow a degree of longitude gets for them."""
    return float(points.agg(F.max(F.abs("y"))).first()[0] or 0.0)


def candidate_pairs(
    points: DataFrame,
    pieces: DataFrame,
    radius_m: float,
    metric: Metric = LOCAL,
    keys: Sequence[str] = (),
    cell_pairs: int = CELL_PAIRS,
    max_lat: float | None = None,
) -> DataFrame:
    """Point–piece pairs that may lie within the radius, with ``distance_m``.

    ``points`` has ``x, y``; ``pieces`` has ``ax, ay, bx, by_``; ``keys`` are
    further equality columns of both sides (a department, a road key). ``max_lat``
    is the points' largest latitude where the caller knows it.
    """
    keys = list(keys)
    if max_lat is None:
        max_lat = 0.0 if metric.planar else largest_latitude(points)
    rx, ry = metric.reach(radius_m, max_lat)
    located, spread, on = with_salts(with_cells(points, rx, ry), spread_pieces(pieces, rx, ry), ["_cx", "_cy", *keys], cell_pairs)
    kx, ky = metric.scales(F.col("y"))
    return located.join(spread, on).withColumn(
        "distance_m",
        piece_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), kx, ky),
    )


def numbered(pieces: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct pieces, staged with a number each (``_piece``)."""
    chosen = pieces.select(*dict.fromkeys(["ax", "ay", "bx", "by_", *columns])).distinct()
    return stage(chosen.withColumn("_piece", F.monotonically_increasing_id()), "numbered-pieces")


def block_sizes(located: DataFrame, spread: DataFrame, on: list[str], block_rows: int) -> DataFrame:
    """Parts of the points and shares of the pieces of each cell that holds both, ``block_rows`` of either in a block; staged."""
    held = located.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).join(spread.groupBy(*on).agg(F.count(F.lit(1)).alias("m")), on)
    return stage(held.select(*on, *(F.ceil(F.col(c) / block_rows).cast("long").alias(name) for c, name in (("n", "_parts"), ("m", "_shares")))), "blocks")


def _blocks(located: DataFrame, spread: DataFrame, sizes: DataFrame, on: list[str], point: Sequence[str], piece: Sequence[str]) -> DataFrame:
    """Points and pieces by block: every part of a cell's points (by the columns ``point``) meets every share of its pieces."""
    sizes, every = small_side(sizes), lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    dealt = lambda columns, name: F.pmod(F.xxhash64(*columns), F.col(name))
    located = located.join(sizes, on).withColumn("_part", dealt(point, "_parts")).withColumn("_share", every("_shares")).drop("_parts", "_shares")
    spread = spread.join(sizes, on).withColumn("_share", dealt(piece, "_shares")).withColumn("_part", every("_parts")).drop("_parts", "_shares")
    block, session = [*on, "_part", "_share"], located.sparkSession
    # a number of its own: few bytes are much work here, so blocks must not be put together by size
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    left, right = (df.repartition(tasks, *block).groupBy(*block) for df in (located, spread))
    return left.cogroup(right)


def _taken(left: pa.Table, right: pa.Table, order: str, metric: Metric) -> tuple[np.ndarray, ...]:
    """Points with their scales, ends of the pieces and the place of each piece's ``order`` among all."""
    x, y = (left[c].to_numpy().astype(float) for c in ("x", "y"))
    ends = np.array([right[c].to_numpy() for c in ("ax", "ay", "bx", "by_")], dtype=float).reshape(4, -1)
    kx = np.ones(len(x)) if metric.planar else metric.lon_m * np.cos(np.radians(y))
    rank = pc.rank(right[order].combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense")
    return x, y, kx, ends, rank.to_numpy().astype(np.int64)


def _kinds(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def met_in_blocks(located: DataFrame, spread: DataFrame, sizes: DataFrame, on: list[str], radius_m: float, metric: Metric,
                  order: str, carry: Sequence[str]) -> DataFrame:
    """Points (cell, id and place) with the columns ``carry`` of the pieces that win in their blocks."""
    out, pieces = ["_cx", "_cy", "point_id", "x", "y"], list(dict.fromkeys([*carry, order, "ax", "ay", "bx", "by_"]))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, kx, ends, rank = _taken(left, right, order, metric)
        i, j = winners(x, y, kx, 1.0 if metric.planar else metric.lat_m, ends, rank, radius_m)
        found, at = left.select(out).take(pa.array(i)), pa.array(j)
        for c in carry:
            found = found.append_column(c, right[c].take(at))
        return found

    spread = spread.select(*dict.fromkeys([*on, *pieces]))
    met = _blocks(located, spread, sizes, on, ["point_id", "x", "y"], carry)
    return met.applyInArrow(meet, f"{_kinds(located, out)}, {_kinds(spread, carry)}")


def winning_pairs(points: DataFrame, pieces: DataFrame, radius_m: float, metric: Metric, keys: Sequence[str], order: str,
                  max_lat: float, cell_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Points with the pieces that win in their blocks: all that ``best_of`` needs to find the winner within the radius.

    ``pieces`` are ``numbered``; the pairs have all their columns, the point's cell and ``distance_m``.
    """
    on, there, block_rows = ["_cx", "_cy", *keys], [f"{k} is not null" for k in keys], max(1, math.isqrt(cell_pairs))
    rx, ry = metric.reach(radius_m, max_lat)
    located = with_cells(points, rx * BLOCK_SIDE, ry * BLOCK_SIDE)
    spread = spread_pieces(pieces.select(*dict.fromkeys(["_piece", "ax", "ay", "bx", "by_", order, *keys])), rx, ry, BLOCK_SIDE)
    for have in there:
        located, spread = located.where(have), spread.where(have)
    met = met_in_blocks(located, spread, block_sizes(located, spread, on, block_rows), on, radius_m, metric, order, ["_piece"])
    kx, ky = metric.scales(F.col("y"))
    return met.join(pieces, "_piece").withColumn("distance_m", piece_distance(
        F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), kx, ky)).where(F.col("distance_m") <= radius_m)


def _micrometres() -> Column:
    return F.floor(F.col("distance_m") * 1e6 + 0.5).alias("_um")


def nearest(
    points: DataFrame,
    pieces: DataFrame,
    radii_m: Sequence[float],
    attributes: Sequence[str],
    metric: Metric = LOCAL,
    keys: Sequence[str] = (),
    order: str = "way_id",
    foot: bool = False,
    cell_pairs: int = BLOCK_PAIRS,
    beyond: bool = False,
) -> DataFrame:
    """Nearest piece of each point within the largest radius, or at any distance with ``beyond``.

    ``points`` needs ``point_id, x, y`` (plus ``keys``). Small radii run first,
    and only points without a hit go on to the next, so sparse areas alone pay
    for wide cells. With ``beyond`` only the first radius is searched by cells; who has no hit
    there goes down the pyramid, which finds the nearest at any distance. Distances equal to the
    micrometre are decided by the smallest ``order`` value, so shared end points do not depend on float noise.
    Returns ``point_id, distance_m`` and the attributes of the winning piece.
    """
    keys, attributes = list(keys), list(attributes)
    left = points.select("point_id", "x", "y", *keys).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    found, radii = None, [radii_m[0]] if beyond else list(radii_m)
    max_lat = 0.0 if metric.planar else largest_latitude(left)
    listed = numbered(pieces, [*keys, order, *attributes])
    for i, radius in enumerate(radii):
        pairs = winning_pairs(left, listed, radius, metric, keys, order, max_lat, cell_pairs)
        if foot:
            kx, ky = metric.scales(F.col("y"))
            pairs = pairs.withColumn(
                "foot",
                foot_point(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"), kx, ky),
            )
        payload = [*attributes, *(["foot"] if foot else [])]
        best = best_of(pairs, ["_cx", "_cy", *keys, "point_id"], payload, order)
        more = beyond or i + 1 < len(radii)
        if more:
            best = stage(best, "nearest")
            left = stage(left.join(best.select("point_id"), "point_id", "left_anti"), "left")
        found = best if found is None else found.unionByName(best)
        if more and left.isEmpty():
            return found
    if beyond:
        found = found.unionByName(nearest_anywhere(left, pieces, attributes, metric, keys, order, foot))
    return found


def nearest_by_bounds(points: DataFrame, ways: DataFrame, degrees: float, attributes: Sequence[str],
                      metric: Metric = LOCAL, order: str = "way_id", keys: Sequence[str] = ()) -> DataFrame:
    """Nearest road among those whose bounds, grown by ``degrees``, hold the point.

    ``ways`` has ``coords`` and ``min_lon … max_lat``. Meant for the few points
    no radius search has settled.
    """
    size = 2 * degrees

    def cell(col: Column) -> Column:
        return F.floor(col / F.lit(size)).cast("long")

    spread = ways.withColumn(
        "_cx", F.explode(F.sequence(cell(F.col("min_lon") - degrees), cell(F.col("max_lon") + degrees)))
    ).withColumn("_cy", F.explode(F.sequence(cell(F.col("min_lat") - degrees), cell(F.col("max_lat") + degrees))))
    located = points.select("point_id", "x", "y", *keys, cell(F.col("x")).alias("_cx"), cell(F.col("y")).alias("_cy"))
    kx, ky = metric.scales(F.col("y"))
    pairs = located.join(spread, ["_cx", "_cy", *keys]).filter(
        F.col("x").between(F.col("min_lon") - degrees, F.col("max_lon") + degrees)
        & F.col("y").between(F.col("min_lat") - degrees, F.col("max_lat") + degrees)
    )
    distance = F.array_min(
        F.transform(
            line_pieces(F.col("coords")),
            lambda p: piece_distance(F.col("x"), F.col("y"), p.ax, p.ay, p.bx, p.by, kx, ky),
        )
    )
    return (
        pairs.withColumn("distance_m", distance)
        .groupBy("_cx", "_cy", *keys, "point_id")
        .agg(F.min(F.struct(_micrometres(), order, "distance_m", *[a for a in attributes if a != order])).alias("_b"))
        .select("point_id", "_b.distance_m", *[f"_b.{a}" for a in attributes])
    )


def k_nearest(
    points: DataFrame,
    pieces: DataFrame,
    radius_m: float,
    k: int,
    attributes: Sequence[str],
    metric: Metric = NAMED,
    keys: Sequence[str] = (),
    order: str = "way_id",
    digits: int | None = None,
    cell_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """The ``k`` nearest roads (``order`` identifies a road) of each point within a radius, ranked from 1.

    With ``digits`` the distance is rounded before ranking, so that roads equal
    at that precision are ordered by ``order``. Points and pieces meet in blocks, which measure
    a point against the few pieces around it and rank its roads; pairs of a point with a farther road are not made.
    """
    keys, lat_m = list(keys), 1.0 if metric.planar else metric.lat_m
    wanted = {f"_of_{a}": a for a in attributes if a != order}
    columns, road = list(dict.fromkeys([order, "ax", "ay", "bx", "by_", *keys])), Window.partitionBy(order)
    # a window, since a join could send a network with a small file through the driver
    listed = pieces.where(F.col(order).isNotNull()) if wanted else pieces
    listed = placed_pieces(listed.select(*columns, *[F.min(a).over(road).alias(name) for name, a in wanted.items()])).distinct()
    listed = stage(listed, "listed-pieces")
    located = points.select("point_id", "x", "y", *keys)
    rx, ry = metric.reach(radius_m, 0.0 if metric.planar else largest_latitude(located))
    # an id counts once in a cell as wide as the radius; blocks are wider
    located = with_cells(located, rx, ry).withColumnsRenamed({"_cx": "_fx", "_cy": "_fy"})
    located = located.withColumns({c: F.floor(F.col(fine) / SIDE_CELLS) for c, fine in (("_cx", "_fx"), ("_cy", "_fy"))})
    spread, wide = listed, lambda col, r: F.floor(_cell(col, r) / SIDE_CELLS)
    for c, a, b, r in (("_cx", "ax", "bx", rx), ("_cy", "ay", "by_", ry)):
        spread = spread.withColumn(c, F.explode(F.sequence(wide(F.least(a, b) - r, r), wide(F.greatest(a, b) + r, r))))
    on = ["_cx", "_cy", *keys]
    for key in keys:
        located, spread = located.where(F.col(key).isNotNull()), spread.where(F.col(key).isNotNull())
    mine, theirs = ["_fx", "_fy", *keys, "point_id"], [order, *wanted]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, kx, ends, road = _taken(left, right, order, metric)
        who = pc.rank(left["point_id"].combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        for c in ("_fx", "_fy"):
            who = who * SIDE_CELLS + left[c].to_numpy() % SIDE_CELLS
        i, j, distance, rank = k_winners(x, y, kx, lat_m, ends, road, radius_m, k, digits, who)
        found, at = left.select(mine).take(pa.array(i)), pa.array(j)
        for c in theirs:
            found = found.append_column(c, right[c].take(at))
        return found.append_column("distance_m", pa.array(distance)).append_column("candidate_rank", pa.array(rank, pa.int32()))

    def ranked(sizes: DataFrame) -> DataFrame:
        met = _blocks(located, spread, sizes, on, ["_fx", "_fy", "point_id"], [order, "ax", "ay", "bx", "by_"])
        return met.applyInArrow(meet, f"{_kinds(located, mine)}, {_kinds(listed, theirs)}, distance_m double, candidate_rank int")

    sizes = block_sizes(located, spread, on, max(1, math.isqrt(cell_pairs)))
    found, shared = ranked(sizes.where("_shares = 1")), sizes.where("_shares > 1")
    if not shared.isEmpty():  # the best of each share come together
        roads = ranked(shared).groupBy(*mine, order).agg(F.min("distance_m").alias("distance_m"), *[F.first(a).alias(a) for a in wanted])
        found = found.unionByName(roads.withColumn(
            "candidate_rank", F.row_number().over(Window.partitionBy(*mine).orderBy("distance_m", order))).where(F.col("candidate_rank") <= k))
    name_of = {a: name for name, a in wanted.items()}
    return found.select("point_id", "candidate_rank", "distance_m", *[F.col(name_of.get(a, a)).alias(a) for a in attributes])


def nearest_of_key(points: DataFrame, pieces: DataFrame, key: str, attributes: Sequence[str],
                   metric: Metric = LOCAL, order: str = "way_id") -> DataFrame:
    """Nearest piece of one given road per point, at any distance: cells first, so that a road with
    very many points or pieces is spread over the places it runs through."""
    keyed = points.filter(F.col(key).isNotNull())
    known = pieces.select(key).distinct()
    return nearest(keyed.join(known, key, "left_semi"), pieces, (1_000.0, 20_000.0), attributes, metric, [key], order, beyond=True)
