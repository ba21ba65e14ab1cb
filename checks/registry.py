"""Registered queries and their oracles, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sql import cols, guard_rounds, select
from corridor_spark.functions.numbers import rounded
from corridor_spark.layers import Layers, layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Columns of a spec, doubles rounded to the digits it names."""
    return df.select(
        *[rounded(F.col(c).cast("double"), d).alias(c) if d is not None else F.col(c) for c, d in cols(spec)]
    )


def add(name: str, spec: str, build: Callable[[Layers], DataFrame], ctes: str | None = None,
        source: str | None = None) -> None:
    """Register a query over the layers, with its oracle when SQL can express it."""
    assert name not in QUERIES, name

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(build(layers(spark, sf_dir)), spec)

    QUERIES[name] = run
    if source is not None:
        ORACLES[name] = guard_rounds((f"WITH {ctes} " if ctes else "") + select(spec, source))
