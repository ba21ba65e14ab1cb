"""Road lines of KML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.functions.geo import kml_coordinates

PLACEMARK = """name string, styleUrl string,
    LineString struct<coordinates: string>,
    MultiGeometry struct<LineString: array<struct<coordinates: string>>>"""


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of every placemark: ``name, style, coords`` (lines of two points or more)."""
    marks = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", True).schema(PLACEMARK).load(path)
    texts = F.array_compact(F.concat(
        F.array(F.col("LineString.coordinates")),
        F.coalesce(F.transform("MultiGeometry.LineString", lambda line: line.coordinates), F.array().cast("array<string>")),
    ))
    lines = marks.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("styleUrl", F.lit("")).alias("style"),
                         F.explode(texts).alias("_t"))
    coords = F.transform(kml_coordinates(F.col("_t")), lambda p: F.array(p.lon, p.lat))
    return lines.select("name", "style", coords.alias("coords")).filter(F.size("coords") >= 2)


def road_stats(lines: DataFrame) -> DataFrame:
    """Lines, vertices, length and extent of a road layer."""
    from corridor_spark.functions.geo import line_length_m
    from corridor_spark.sources.roads import with_bounds

    return with_bounds(lines).agg(
        F.count(F.lit(1)).alias("line_strings"), F.sum(F.size("coords")).alias("vertices"),
        (F.sum(line_length_m(F.col("coords"))) / 1000).alias("total_length_km"), F.min("min_lon").alias("min_lon"),
        F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def styles(lines: DataFrame) -> DataFrame:
    return lines.filter("style != ''").groupBy("style").agg(F.count(F.lit(1)).alias("lines"))
