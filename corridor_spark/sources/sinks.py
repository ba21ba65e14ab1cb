"""Writers: GeoJSON feature lines, map layers and named tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.text import traffic_compact


def point_features(df: DataFrame, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON point feature per row with a point, as text in ``value``."""
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        F.to_json(F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")).alias("geometry"),
            F.struct(*properties).alias("properties"),
        )).alias("value")
    )


def line_features(segs: DataFrame, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON line feature per segment, as text in ``value``."""
    return segs.select(
        F.to_json(F.struct(
            F.lit("Feature").alias("type"),
            F.struct(F.lit("LineString").alias("type"), F.col("coords").alias("coordinates")).alias("geometry"),
            F.struct(*properties).alias("properties"),
        )).alias("value")
    )


def write_features(features: DataFrame, path: str) -> None:
    """Newline-delimited features; each task writes its own part."""
    features.write.mode("overwrite").text(path)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Every named table as Parquet (or CSV with a header)."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if fmt == "csv":
            flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes])
            flat.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            writer.format(fmt).save(f"{folder}/{name}")


JAM_LAYER = ("corridor_norm", "jams_count_total", "corridor_delay_burden", "corridor_congestion_load",
             "corridor_speed_collapse_rate", "active_congestion_hours", "corridor_jam_pressure_score",
             "corridor_match_confidence_avg")
ALERT_LAYER = ("corridor_norm_alert", "alerts_count_total", "reports_count_total", "corridor_alert_impact",
               "active_alert_hours", "critical_alert_rate", "high_spatial_rate", "corridor_alert_pressure")


def jam_layer(summary: DataFrame) -> DataFrame:
    known = summary.filter(F.col("corridor_norm") != "UNRESOLVED").select(*JAM_LAYER)
    return known.withColumn("corridor_norm_key", traffic_compact(F.col("corridor_norm")))


def jam_layers(summary: DataFrame, segs: DataFrame) -> DataFrame:
    """Road segments with the jam metrics of their corridor; one corridor per key."""
    layer = jam_layer(summary)
    metrics = layer.groupBy("corridor_norm_key").agg(
        F.max_by(F.struct(*JAM_LAYER), F.struct("corridor_jam_pressure_score", "corridor_norm")).alias("_m")
    ).select("corridor_norm_key", "_m.*")
    keyed = segs.withColumn("corridor_norm_key", traffic_compact(F.col("road_key_norm")))
    return keyed.join(metrics, "corridor_norm_key")


def alert_layer(summary: DataFrame) -> DataFrame:
    known = summary.filter(F.col("corridor_norm_alert") != "UNRESOLVED").select(*ALERT_LAYER)
    return known.withColumn("corridor_norm_key", traffic_compact(F.col("corridor_norm_alert")))


ALERT_PROPERTIES = ("uuid", "type", "subtype", "alert_group", "city", "street", "event_hour", "cluster_report_count",
                    "severity_proxy", "alert_impact_score", "corridor_norm_alert", "osm_match_status",
                    "nearest_osm_distance_m")


def alert_features(alerts: DataFrame) -> DataFrame:
    return point_features(alerts, "lon", "lat", ALERT_PROPERTIES)
