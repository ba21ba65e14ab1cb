"""Alias tables: raw road text → corridor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import number_or
from corridor_spark.functions.text import compact_text, road_text
from corridor_spark.lexicons import CITY_DEPARTMENTS
from corridor_spark.operators.tables import ensure_columns

ALIAS_COLUMNS = {
    "raw_value": "string", "raw_value_norm": "string", "corridor_norm": "string", "corridor_group": "string",
    "road_scope": "string", "source_type": "string", "notes": "string", "priority": "double",
}


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Alias CSV as it was written, all text."""
    return spark.read.option("header", True).csv(path)


def alias_lookup(aliases: DataFrame) -> DataFrame:
    """One row per normalised key: the highest priority wins, then the smallest raw key."""
    table = ensure_columns(aliases, ALIAS_COLUMNS)
    raw = F.coalesce(F.nullif(F.trim("raw_value_norm"), F.lit("")), F.col("raw_value"))
    keyed = table.withColumns(
        {"key": road_text(raw), "priority": number_or(F.col("priority"), 50)}
    ).filter(F.col("key") != "")
    kept = ["corridor_norm", "corridor_group", "road_scope", "source_type", "notes"]
    best = F.min(F.struct((-F.col("priority")).alias("_neg"), raw.alias("_raw"),
                          *[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in kept]))
    return keyed.groupBy("key").agg(best.alias("_w")).select(
        "key", (-F.col("_w._neg")).alias("priority"), *[f"_w.{c}" for c in kept]
    )


def city_aliases(spark: SparkSession, table: dict[str, tuple[str, ...]] = CITY_DEPARTMENTS) -> DataFrame:
    """Place names and the department they stand for."""
    rows = [(alias, department) for department, aliases in table.items() for alias in aliases]
    raw = spark.createDataFrame(rows, "alias string, department string")
    return raw.select(compact_text(F.col("alias")).alias("key"), "department")
