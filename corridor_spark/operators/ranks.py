"""Ranks and correlations over a whole table without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import rounded
from corridor_spark.session import stage

ROWS_PER_SLICE = 1_000_000


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False,
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """One row per distinct value (per group) with ``rank_min``, ``rank_avg`` and ``n``.

    Equal values are counted before anything is ordered. The distinct values
    are cut into slices at sketched quantiles; each slice is ranked on its own
    and shifted by the totals of the slices before it.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.count()
    slices = 1 + total // rows_per_slice
    key = -F.col(value) if descending else F.col(value)
    if slices > 1:
        cuts = [i / slices for i in range(1, slices)]
        edges = sorted(set(counts.agg(F.percentile_approx(key, cuts, 100 * slices).alias("e")).first()["e"]))
        edge_array = F.array(*map(F.lit, edges))
        counts = counts.withColumn("_slice", F.size(F.filter(edge_array, lambda e: e < key)))
        counts = stage(counts, "rank-counts")
    else:
        counts = counts.withColumn("_slice", F.lit(0))
    totals = counts.groupBy(*by, "_slice").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    start = F.col("_before") + F.col("_offset")
    return ranked.join(offsets, [*by, "_slice"]).select(
        *by,
        value,
        "n",
        (start + 1).alias("rank_min"),
        (start + (F.col("n") + 1) / 2).alias("rank_avg"),
    )


def with_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Rows with their minimum rank (ties share the smallest)."""
    by = list(by)
    ranks = value_ranks(df, value, by, descending).select(*by, value, F.col("rank_min").alias(out))
    return df.join(ranks, [*by, value])


def correlations(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, Pearson and Spearman correlation of two columns (per group).

    Fewer than three rows, or a constant column, give 0.
    """
    groups = list(by) or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(1))
    pairs = df.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_w"))
    expanded = df.select(*groups, x, y)
    rx = value_ranks(expanded, x, groups).select(*groups, x, F.col("rank_avg").alias("_rx"))
    ry = value_ranks(expanded, y, groups).select(*groups, y, F.col("rank_avg").alias("_ry"))
    joined = pairs.join(rx, [*groups, x]).join(ry, [*groups, y])
    # Values are centred first, so that large values do not cancel in the sums of squares.
    parts = {"x": x, "y": y, "rx": "_rx", "ry": "_ry"}
    means = joined.groupBy(*groups).agg(
        *[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(f"_m{p}") for p, c in parts.items()])
    joined = joined.join(means, groups).withColumns({f"_c{p}": F.col(c) - F.col(f"_m{p}") for p, c in parts.items()})
    return joined.groupBy(*groups).agg(
        F.sum("_w").alias("n_rows"),
        _weighted_corr(F.col("_cx"), F.col("_cy")).alias("pearson"),
        _weighted_corr(F.col("_crx"), F.col("_cry")).alias("spearman"),
    ).select(
        *by,
        "n_rows",
        *[
            rounded(F.when(F.col("n_rows") > 2, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0), 4).alias(c)
            for c in ("pearson", "spearman")
        ],
    )


def _weighted_corr(x: Column, y: Column) -> Column:
    w = F.col("_w").cast("double")
    x, y = x.cast("double"), y.cast("double")
    n = F.sum(w)
    cov = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / n
    var_x = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / n
    var_y = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / n
    return F.try_divide(cov, F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0))))
