"""Small relational helpers shared by the analyses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corridor_spark.functions.numbers import percent, rounded
from corridor_spark.session import stage


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing optional columns as typed nulls."""
    missing = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def empty_like(spark, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def metric_rows(df: DataFrame, metrics: Sequence[tuple[str, Column]], total: Column | None = None) -> DataFrame:
    """One global aggregate as ``metric, value`` rows (and ``percent`` of ``total`` when given).

    A metric given as a three-tuple ``(name, column, False)`` has no percent.
    """
    aggs = [m[1].cast("double").alias(f"_v{i}") for i, m in enumerate(metrics)]
    whole = [] if total is None else [total.cast("double").alias("_total")]
    row = df.agg(*aggs, *whole)
    structs = []
    for i, m in enumerate(metrics):
        share = total is not None and (len(m) < 3 or m[2])
        value = F.col(f"_v{i}")
        pct = percent(value, F.col("_total")) if share else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(m[0]).alias("metric"), rounded(value, 4).alias("value"), pct.alias("percent")))
    out = row.select(F.explode(F.array(*structs)).alias("_m")).select("_m.*")
    return out if total is not None else out.drop("percent")


def share_table(df: DataFrame, col: str, out: str | None = None, count: str = "events",
                missing: str = "SIN_DATO") -> DataFrame:
    """Count and percent of each value; null becomes a written sentinel."""
    out = out or col
    counts = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias(out)).agg(
        F.count(F.lit(1)).alias(count)
    )
    whole = counts.agg(F.sum(count)).scalar()
    return counts.withColumn("percent", percent(F.col(count), whole))


def unique_join(col: Column) -> Column:
    """Aggregate: sorted distinct non-blank values joined by ``"; "``; for columns of few values."""
    return F.array_join(F.array_sort(F.collect_set(F.when(F.trim(col) != "", F.trim(col)))), "; ")


def with_capped_lists(grouped: DataFrame, df: DataFrame, by: Sequence[str], columns: dict[str, str], limit: int,
                      more: bool = True) -> DataFrame:
    """Groups with, per column, the first ``limit`` distinct non-blank values joined by ``"; "``.

    ``grouped`` has one row per value of ``by`` (null is a value), ``columns`` maps the new columns to those
    of ``df``; with ``more`` the other values are counted as ``+N mas``. A group without a value gets "".
    Group, column and value are made distinct first, then ranked: tasks keep ``limit`` values
    each before they meet, so a group of very many values is never in one list.
    """
    by, names = list(by), list(columns)
    cells = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.trim(F.col(columns[n]).cast("string")).alias("_v")) for i, n in enumerate(names)
    ])).alias("_c")).select(*by, "_c._i", "_c._v").filter(F.col("_v") != "")
    values = stage(cells.distinct(), "list-values")
    place = F.row_number().over(Window.partitionBy(*by, "_i").orderBy("_v"))
    top = values.withColumn("_r", place).filter(F.col("_r") <= limit).select(*by, "_i", "_v", F.lit(0).cast("long").alias("_n"))
    counts = values.groupBy(*by, "_i").agg(F.count(F.lit(1)).alias("_n")).select(
        *by, "_i", F.lit(None).cast("string").alias("_v"), "_n")

    def shown(i: int) -> Column:
        of = lambda c: F.when(F.col("_i") == i, F.col(c))
        head, rest = F.array_join(F.array_sort(F.collect_list(of("_v"))), "; "), F.max(of("_n")) - limit
        if not more:
            return head
        return F.when(rest > 0, F.concat(head, F.lit("; +"), rest.cast("string"), F.lit(" mas"))).otherwise(head)

    lists = top.unionByName(counts).groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[shown(i).alias(f"_l{i}") for i in range(len(names))])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return grouped.join(lists, same, "left").select(
        *grouped.columns, *[F.coalesce(f"_l{i}", F.lit("")).alias(n) for i, n in enumerate(names)])


def mode_nonblank(col: Column) -> Column:
    """Aggregate: most frequent non-blank value, the smallest on ties; blank when there is none."""
    return F.coalesce(F.mode(F.when(F.trim(col) != "", col), True), F.lit(""))


def first_by(col: Column, order: Column) -> Column:
    """Aggregate: first non-null value in the given order."""
    return F.min_by(col, F.when(col.isNotNull(), order))


def top_values(df: DataFrame, by: Sequence[str], col: str, k: int, out: str, sep: str = "; ",
               counts: bool = True) -> DataFrame:
    """Per group the ``k`` most frequent non-blank values, written in order."""
    by = list(by)
    n = df.filter(F.trim(F.col(col)) != "").groupBy(*by, F.trim(F.col(col)).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "_v"))
    top = n.withColumn("_r", rank).filter(F.col("_r") <= k)
    shown = F.concat(F.col("_v"), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")) if counts else F.col("_v")
    return top.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", shown.alias("s")))), lambda x: x["s"]), sep)
        .alias(out)
    )


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def rollup_table(df: DataFrame, keys: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """Grouped measures; null keys are kept as a group."""
    return df.groupBy(*keys).agg(*[m.alias(name) for name, m in measures.items()])


def conditional(cond: Column) -> Column:
    """Aggregate: rows where the condition holds."""
    return F.count_if(F.coalesce(cond, F.lit(False)))
