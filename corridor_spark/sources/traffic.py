"""Traffic jam observations and alerts: JSON envelopes and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.sources import envelopes

JAM_RECORD = """uuid string, id string, ts string, city string, street string, startNode string, endNode string,
                country string, level int, delay double, length double, speedKMH double"""
ALERT_RECORD = """uuid string, ts string, type string, subtype string, city string, street string, geoWKT string,
                  cluster_id string, cluster_center_lon double, cluster_center_lat double, cluster_start_ts string,
                  cluster_last_ts string, cluster_report_count int, reliability double, reportRating double,
                  confidence double"""


def _envelope(spark: SparkSession, path: str, record: str, lines: bool, split: bool) -> DataFrame:
    if split:
        return envelopes.records(spark, path, record)
    reader = spark.read.schema(record if lines else f"records array<struct<{_struct(record)}>>")
    raw = reader.option("multiLine", not lines).json(path)
    return raw if lines else raw.select(F.explode("records").alias("r")).select("r.*")


def _struct(record: str) -> str:
    return ", ".join(f"{name}: {dtype}" for name, dtype in (c.split() for c in record.split(",")))


def read_jams(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Jam observations of ``{"records": [...]}`` files (``split``: one large file by many tasks), or of JSON lines."""
    return _jam_names(_envelope(spark, path, JAM_RECORD, lines, split))


def read_alerts(spark: SparkSession, path: str, lines: bool = False, split: bool = False) -> DataFrame:
    """Alerts of ``{"records": [...]}`` files (``split``: one large file by many tasks), or of JSON lines."""
    return _envelope(spark, path, ALERT_RECORD, lines, split).withColumnRenamed("reportRating", "reportrating")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The envelope's own fields, without the records."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.drop("records")


def _jam_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"startNode": "start_node", "endNode": "end_node", "speedKMH": "speedkmh"})
