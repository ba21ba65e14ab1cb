"""Road networks on disk: one folder per network, department and bucket of road keys.

A query opens the folders it needs: networks and departments named in the query
by their partition values, departments and road keys that come from another table
by dynamic partition pruning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.lexicons import MAJOR_HIGHWAYS
from corridor_spark.session import small_side
from corridor_spark.sources.roads import dedup_ways, load_segments

DEPARTMENT, NATIONAL, CAPITAL = "DEPARTMENT", "NATIONAL", "AMSS"
PARTITIONS = ("network", "source_department", "road_bucket")
#: Buckets of road keys in each department.
BUCKETS = 8


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_store(path: str, departments: DataFrame | None = None, whole: DataFrame | None = None,
                capital: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Write the department, national and capital networks that there are.

    Each is a segment table; a way that the national one holds twice is kept once. Blank departments
    are written as unknown (null). Rows are rebalanced by partition, so that a department or a
    road with most of the rows is written by several tasks and none writes many small files.
    """
    given = {DEPARTMENT: departments, NATIONAL: None if whole is None else dedup_ways(whole), CAPITAL: capital}
    parts = [segs.withColumn("network", F.lit(name)) for name, segs in given.items() if segs is not None]
    if not parts:
        raise ValueError("a road store needs a network")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.withColumns({
        "source_department": F.when(F.trim("source_department") != "", F.col("source_department")),
        "road_bucket": _bucket(F.col("road_key_norm"), buckets), "buckets": F.lit(buckets),
    })
    rows.hint("rebalance", *[F.col(c) for c in PARTITIONS]).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments; departments stay text whatever they look like."""
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns).parquet(f"{path}/rows")


def network(store: DataFrame, name: str, departments: Sequence[str] | None = None) -> DataFrame:
    """Segments of a network, of some departments where they are given."""
    rows = store.filter(F.col("network") == name)
    return rows if departments is None else rows.filter(F.col("source_department").isin(*departments))


def departments_of(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Segments of the department networks that the rows' ``source_department`` names."""
    wanted = rows.filter(F.length("source_department") > 0).select("source_department").distinct()
    return network(store, DEPARTMENT).join(small_side(wanted), "source_department", "left_semi")


def stored_departments(store: DataFrame) -> DataFrame:
    """Departments that have a network of their own; reads no column of the files."""
    return network(store, DEPARTMENT).filter(F.col("source_department").isNotNull()).select("source_department").distinct()


def select_segments(store: DataFrame, departments: Sequence[str] = (), major_only: bool = True) -> DataFrame:
    """Segments to show for some departments, each way once.

    Their own networks; where none of them has one the national network; without
    that, or without departments, the capital's.
    """
    own = network(store, DEPARTMENT, list(departments)) if departments else None
    if own is None or own.isEmpty():
        whole = network(store, NATIONAL)
        own = whole if departments and not whole.isEmpty() else network(store, CAPITAL)
    return load_segments(own.drop("network", "road_bucket", "buckets"), (), major_only)


def stored_roads(store: DataFrame, keys: DataFrame, key: str = "corridor_key", name: str = NATIONAL,
                 major_only: bool = True) -> DataFrame:
    """Segments of a network whose road key is listed; opens only the buckets of those keys."""
    rows = network(store, name)
    if major_only:
        rows = rows.filter(F.col("highway").isin(*MAJOR_HIGHWAYS))
    first = store.select("buckets").first()
    if first is None:
        return rows
    wanted = keys.select(F.col(key).alias("road_key_norm")).filter(F.length("road_key_norm") > 0).distinct().withColumn(
        "road_bucket", _bucket(F.col("road_key_norm"), first["buckets"]))
    return rows.join(small_side(wanted), ["road_bucket", "road_key_norm"], "left_semi")

