"""Structured Streaming forms of the window queries.

Event time is a ``timestamp`` column ``ts``. Windowed queries accept late rows up
to the watermark and drop older state, so it stays bounded. The newest snapshot
of a mention and the measures of a jam have no end; their state is one row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from corridor_spark.functions.numbers import rounded, time_period
from corridor_spark.operators.cell_index import CellIndex, nearest_indexed
from corridor_spark.operators.norms import weighted
from corridor_spark.session import exists, scratch, stage

LATE = "15 minutes"
#: Length of the frames into which running measures are cut.
FRAME = "1 hour"


def read_stream(spark: SparkSession, path: str, schema, time: str = "ts", fmt: str = "parquet", files: int = 100) -> DataFrame:
    """File stream with an event-time column; zone-less times are taken as UTC."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def accumulated(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running totals per local day and key, for update mode; a day's state goes once the watermark passes it."""
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("day"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.to_date("day.start").alias("day"), key, "n", "total")


def sliding(stream: DataFrame, key: str, value: str, length: str = "60 minutes", step: str = "5 minutes") -> DataFrame:
    """Moving window per key."""
    return _windowed(stream, key, value, F.window("ts", length, step))


def tumbling(stream: DataFrame, key: str, value: str, length: str = "15 minutes") -> DataFrame:
    """New rows per half-open frame and key."""
    return _windowed(stream, key, value, F.window("ts", length))


def _windowed(stream: DataFrame, key: str, value: str, window) -> DataFrame:
    return stream.withWatermark("ts", LATE).groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def latest_snapshots(stream: DataFrame, keys: list[str], columns: list[str], frame: str = FRAME, late: str = LATE) -> DataFrame:
    """Newest snapshot of each mention and frame, for update mode; ``newest_of`` makes the mention's of them.

    State is one row a mention and open frame: that of a quiet mention goes once the
    watermark passes its last frame, and comes back with its next snapshot.
    """
    return _framed(stream.withWatermark("ts", late), keys, frame).agg(
        F.max_by(F.struct("ts", *columns), F.struct("ts", *columns)).alias("_s"), F.count(F.lit(1)).alias("snapshots")
    ).select(*keys, F.col("_w.start").alias("frame"), "_s.*", "snapshots")


def newest_of(frames: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Newest snapshot of each mention over all its frames."""
    return frames.groupBy(*keys).agg(
        F.max_by(F.struct("ts", *columns), F.struct("ts", *columns)).alias("_s"), F.sum("snapshots").alias("snapshots")
    ).select(*keys, "_s.*", "snapshots")


#: Measures of a jam: extremes with their aggregate, means with their column.
_EXTREMES = {"level_max": F.max, "delay_max": F.max, "length_max": F.max, "speed_min": F.min}
_MEANS = {"level_mean": "level", "delay_mean": "delay", "speed_mean": "speedkmh"}


def running_jams(stream: DataFrame, frame: str = FRAME, late: str = LATE) -> DataFrame:
    """Sums and extremes of each jam and frame, for update mode; ``jam_measures`` makes the jam's of them.

    Observations repeated within the watermark count once, rows later than it are
    left out. State is one row a jam and open frame, however long jams go on and
    whether or not a quiet one comes back.
    """
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    column = {"level_max": "level", "delay_max": "delay", "length_max": "length", "speed_min": "speedkmh"}
    return _framed(once, ["uuid"], frame).agg(
        F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"),
        *[pick(column[name]).alias(name) for name, pick in _EXTREMES.items()],
        *[F.sum(F.col(c).cast("double")).alias(f"{name}_sum") for name, c in _MEANS.items()],
        *[F.count(c).alias(f"{name}_n") for name, c in _MEANS.items()],
        F.count(F.lit(1)).alias("records_per_uuid"),
    ).withColumn("frame", F.col("_w.start")).drop("_w")


def jam_measures(frames: DataFrame) -> DataFrame:
    """Order-free measures of each jam so far, over all its frames."""
    return frames.groupBy("uuid").agg(
        F.min("ts_first").alias("ts_first"), F.max("ts_last").alias("ts_last"),
        *[pick(name).alias(name) for name, pick in _EXTREMES.items()],
        *[F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n")).alias(name) for name in _MEANS],
        F.sum("records_per_uuid").alias("records_per_uuid"),
    ).withColumn("time_period", time_period(F.hour("ts_first")))


def _framed(stream: DataFrame, keys: list[str], frame: str) -> GroupedData:
    return stream.groupBy(F.window("ts", frame).alias("_w"), *keys)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Run ``handle`` on every micro-batch (a ranking, a nearest join), once for what is there now; a restart goes on from ``checkpoint``."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        handle).start()


def nearest_in_batch(index: CellIndex, out_path: str, attributes: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler: nearest road of each point, written under the batch's number so that a retry overwrites it.

    The network was listed in cells once (``write_cells``); a batch opens the tiles that its points lie in.
    """

    def handle(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            nearest_indexed(batch, index, attributes).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return handle


MEASURES = ("visible_jams", "visible_delay_min", "visible_congestion_load", "visible_jam_intensity")


def source_totals(stream: DataFrame, length: str = "60 minutes", step: str = "15 minutes") -> DataFrame:
    """Jam measures, alert and news impact per corridor and window.

    The stream has ``ts, corridor_key, source`` (jam, alert or news), for jams
    ``delay_min, congestion_load, jam_intensity``, for the others ``impact``.
    """
    jam, of = F.col("source") == "jam", lambda name: F.sum(F.when(F.col("source") == name, F.col("impact")).otherwise(0.0))
    return stream.withWatermark("ts", LATE).groupBy(F.window("ts", length, step).alias("w"), "corridor_key").agg(
        F.count_if(jam).alias("visible_jams"), F.sum(F.when(jam, F.col("delay_min"))).alias("visible_delay_min"),
        F.sum(F.when(jam, F.col("congestion_load"))).alias("visible_congestion_load"),
        F.avg(F.when(jam, F.col("jam_intensity"))).alias("visible_jam_intensity"),
        of("alert").alias("alert_impact"), of("news").alias("news_impact"),
    ).select(F.col("w.end").alias("window_end"), "corridor_key", *MEASURES, "alert_impact", "news_impact")


def _scaled(rows: DataFrame, columns: tuple[str, ...], out: str, weights: tuple[float, ...]) -> DataFrame:
    """Weighted sum of columns, each from 0 to the 95 % quantile (or maximum) of its own window."""
    value = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    tops = rows.groupBy("window_end").agg(*[F.struct(F.percentile(value(c), 0.95).alias("q"), F.max(value(c)).alias("m")).alias(f"_{c}") for c in columns])
    top = lambda c: F.when(F.col(f"_{c}.q") > 0, F.col(f"_{c}.q")).otherwise(F.col(f"_{c}.m"))
    part = lambda c: F.when(top(c) > 0, F.least(value(c) / top(c), F.lit(1.0))).otherwise(0.0)
    total = rounded(100 * weighted([(w, part(c)) for w, c in zip(weights, columns)]), 3)
    return rows.join(tops, "window_end").withColumn(out, total).drop(*[f"_{c}" for c in columns])


def rank_windows(totals: DataFrame, top_n: int = 90) -> DataFrame:
    """Corridors of each window by dynamic pressure.

    Every scale is that of the row's own window, so the result does not depend
    on how the stream was cut into batches. A window's ``top_n`` corridors by jam
    pressure take part with it; a window has as many rows as corridors.
    """
    jams = _scaled(totals.where("visible_jams > 0"), MEASURES, "temporal_jam_pressure", (0.30, 0.30, 0.25, 0.15))
    place = F.row_number().over(Window.partitionBy("window_end").orderBy(F.desc("temporal_jam_pressure"), "corridor_key"))
    rows = jams.withColumn("_place", place).withColumn("_top", F.col("_place") <= top_n).unionByName(
        totals.where("visible_jams = 0").withColumns({"temporal_jam_pressure": F.lit(0.0), "_place": F.lit(0), "_top": F.lit(False)}))
    none = lambda c: F.when(F.col("_top"), F.col(c)).otherwise(F.lit(0)).alias(c)
    rows = rows.where("_top OR alert_impact <> 0 OR news_impact <> 0").select(
        "window_end", "corridor_key", none("visible_jams"), none("temporal_jam_pressure"), "alert_impact", "news_impact")
    return _scaled(rows, ("temporal_jam_pressure", "alert_impact", "news_impact"), "dynamic_corridor_pressure", (0.45, 0.35, 0.20))


def rank_in_batch(out_path: str) -> Callable[[DataFrame, int], None]:
    """Batch handler: ranking of the finished windows (append mode brings all corridors of a window together)."""

    def handle(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            rank_windows(stage(batch, "window-totals")).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return handle


def drain(stream: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Process what is available and return the result table, windows that are still open included.

    Batches write the rows they changed; of each key the newest batch counts. Draining
    into the same folder again goes on where the last time ended.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    each_batch(stream, keep, f"{path}/_state").awaitTermination()
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*").select(*stream.columns)
