"""Interactive queries: facet filters, time windows, window rankings, heat cells, rollups of a filtered set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import minute_label, minute_of_day, number_or, rounded
from corridor_spark.functions.text import clean_corridor, key_text, label, text_or_blank
from corridor_spark.lexicons import FRAME_BOX
from corridor_spark.functions.geo import in_box
from corridor_spark.operators.norms import fit_scale, weighted
from corridor_spark.operators.tables import metric_rows
from corridor_spark.plans.incidents import GOOD_MATCH, measures
from corridor_spark.session import stage

SENTINELS = {"department_norm": "SIN_DEPTO", "municipality_norm": "SIN_MUNICIPIO", "corridor_norm": "SIN_CORREDOR",
             "severity_class": "SIN_SEVERIDAD", "text_osm_resolution": "SIN_RESOLUCION", "source": "SIN_FUENTE"}


@dataclass(frozen=True)
class Facets:
    """Chosen values per facet; an absent facet keeps everything."""

    start: str | None = None
    end: str | None = None
    hours: tuple[int, int] = (0, 23)
    values: dict[str, Sequence[str]] = field(default_factory=dict)


def filter_events(events: DataFrame, facets: Facets) -> DataFrame:
    """Events inside all facets; blanks count as their written sentinel."""
    keep = F.coalesce(F.col("event_hour"), F.lit(-1)).between(*facets.hours)
    if facets.start:
        keep = keep & (F.col("event_date") >= F.lit(facets.start).cast("date"))
    if facets.end:
        keep = keep & (F.col("event_date") <= F.lit(facets.end).cast("date"))
    for name, chosen in facets.values.items():
        value = clean_corridor(F.col(name), SENTINELS[name]) if name in SENTINELS else F.col(name)
        keep = keep & value.isin(*chosen)
    return events.filter(keep)


# --- time windows ------------------------------------------------------------


def window_bounds(now: int, mode: str, window: int = 60, frame: int = 15) -> tuple[int, int]:
    """First and last minute of the day of a window mode: accumulated, moving or new."""
    if mode == "accumulated":
        return 0, now
    return max(0, now - (window if mode == "moving" else frame)), now


def in_window(df: DataFrame, start: int, end: int, minute: str = "minute") -> DataFrame:
    """Rows of a minute range, both ends included."""
    return df.filter(F.col(minute).between(start, end))


def day_rows(jams: DataFrame, alerts: DataFrame, news: DataFrame, day: str) -> dict[str, DataFrame]:
    """The three sources on one local day with minute of day and window key."""
    fallback = F.when(F.upper(F.col("corridor_norm")) == "UNRESOLVED", F.col("street_norm")).otherwise(
        F.col("corridor_norm"))
    on_day = lambda df, t: df.withColumn("minute", minute_of_day(F.col(t))).filter(
        F.to_date(t) == F.lit(day).cast("date"))
    out = {
        "jams": on_day(jams, "datetime_local").withColumns(
            {"corridor_norm_key": key_text(fallback), "corridor_name": F.col("corridor_norm")}
        ).filter(~F.col("corridor_norm_key").isin("", "unresolved")),
        "alerts": on_day(alerts, "datetime_local").withColumn("corridor_norm_key", key_text(F.col("corridor_norm_alert"))),
        "news": on_day(news, "event_datetime").withColumn("corridor_norm_key", key_text(F.col("corridor_norm"))),
    }
    return out


def summarize_jams(jams: DataFrame, top_n: int | None = None) -> DataFrame:
    """Visible jams per corridor with their window pressure. Delays are in minutes."""
    g = stage(jams.groupBy("corridor_norm_key").agg(
        F.min("corridor_name").alias("corridor_name"), F.count("uuid").alias("visible_jams"),
        F.sum(F.col("delay_mean") / 60).alias("visible_delay_min"),
        F.sum("congestion_load").alias("visible_congestion_load"), F.avg("jam_intensity_score").alias("visible_jam_intensity"),
        F.sum("length_km").alias("visible_length_km"), F.min("speed_min").alias("visible_speed_min"),
        F.avg("speed_mean").alias("visible_speed_avg"), F.countDistinct("minute").alias("visible_active_minutes"),
        F.count_if("severe_jam_flag").alias("severe_jams"), F.count_if("extreme_jam_flag").alias("extreme_jams"),
        F.count_if("speed_collapse_flag").alias("speed_collapse_jams"),
        F.avg("congestion_reliability_proxy").alias("reliability_avg")), "window-jams")
    s = fit_scale(g, ["visible_jams", "visible_delay_min", "visible_congestion_load", "visible_jam_intensity"])
    out = g.withColumn("temporal_jam_pressure", rounded(100 * weighted([
        (0.30, s.of("visible_jams")), (0.30, s.of("visible_delay_min")), (0.25, s.of("visible_congestion_load")),
        (0.15, s.of("visible_jam_intensity"))]), 3))
    return out if top_n is None else out.orderBy(F.desc("temporal_jam_pressure"), "corridor_norm_key").limit(top_n)


def corridor_ranking(jam_summary: DataFrame, alerts: DataFrame, news: DataFrame) -> DataFrame:
    """One ranking of corridors from the three sources of a window: a union and one grouping."""
    zero = F.lit(0.0)

    def part(df: DataFrame, name: str, order: int, **cols: Column) -> DataFrame:
        wanted = {"visible_jams": zero, "visible_delay_min": zero, "visible_congestion_load": zero,
                  "temporal_jam_pressure": zero, "visible_alerts": zero, "alert_impact": zero, "critical_alerts": zero,
                  "visible_news": zero, "news_impact": zero, "news_mentions": zero} | cols
        return df.select("corridor_norm_key", F.struct(F.lit(order).alias("o"), F.col(name).alias("n")).alias("_n"),
                         *[c.cast("double").alias(k) for k, c in wanted.items()])

    one = F.lit(1)
    rows = part(jam_summary, "corridor_name", 0, **{c: F.col(c) for c in (
        "visible_jams", "visible_delay_min", "visible_congestion_load", "temporal_jam_pressure")}).unionByName(
        part(alerts.filter("corridor_norm_key != ''"), "corridor_norm_alert", 1, visible_alerts=one,
             alert_impact=F.col("alert_impact_score"), critical_alerts=F.col("is_critical_alert").cast("int"))).unionByName(
        part(news.filter("corridor_norm_key != ''"), "corridor_norm", 2, visible_news=one,
             news_impact=F.col("impact_social_score"), news_mentions=F.col("mentions")))
    numbers = [c for c in rows.columns if c not in ("corridor_norm_key", "_n")]
    merged = stage(rows.groupBy("corridor_norm_key").agg(
        F.min("_n")["n"].alias("corridor_name"), *[F.sum(F.coalesce(F.col(c), zero)).alias(c) for c in numbers]),
        "window-ranking")
    s = fit_scale(merged, ["temporal_jam_pressure", "alert_impact", "news_impact"])
    return merged.withColumn("dynamic_corridor_pressure", rounded(100 * weighted([
        (0.45, s.of("temporal_jam_pressure")), (0.35, s.of("alert_impact")), (0.20, s.of("news_impact"))]), 3))


def window_ranking(jams: DataFrame, alerts: DataFrame, news: DataFrame, day: str, now: int, mode: str = "moving",
                   window: int = 60, frame: int = 15, top_n: int = 90) -> DataFrame:
    """Corridor ranking of one window of a day."""
    start, end = window_bounds(now, mode, window, frame)
    rows = {name: in_window(df, start, end) for name, df in day_rows(jams, alerts, news, day).items()}
    return corridor_ranking(summarize_jams(rows["jams"], top_n), rows["alerts"], rows["news"])


def frames(alerts: DataFrame, time: str = "datetime_local", step: str = "15 minutes", trail: str = "60 minutes") -> DataFrame:
    """Alerts per half-open frame, and in the trail that ends with the frame."""
    current = alerts.groupBy(F.window(time, step).alias("w")).agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("alert_impact_score").alias("impact"))
    behind = alerts.groupBy(F.window(time, trail, step).alias("w")).agg(F.count(F.lit(1)).alias("trail_alerts"))
    return behind.select(F.col("w.end").alias("frame_end"), "trail_alerts").join(
        current.select(F.col("w.end").alias("frame_end"), "alerts", "impact"), "frame_end", "left").select(
        "frame_end", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.coalesce("impact", F.lit(0.0)).alias("impact"),
        "trail_alerts")


def alerts_of_day(alerts: DataFrame, day: str, box=FRAME_BOX) -> DataFrame:
    return alerts.filter((F.to_date("datetime_local") == F.lit(day).cast("date")) & in_box(F.col("lat"), F.col("lon"), box))


# --- heat --------------------------------------------------------------------


def heat_points(alerts: DataFrame, news: DataFrame) -> DataFrame:
    """Alert and news points with a weight of at least 1."""
    score = number_or(F.col("impact_social_score"))
    weight = F.when(score > 0, score).otherwise(number_or(F.col("mentions"), 1))
    return alerts.select("lon", "lat", F.greatest(number_or(F.col("alert_impact_score"), 1), F.lit(1.0)).alias("heat_weight")
                         ).unionByName(news.select(F.col("longitude_num").alias("lon"), F.col("latitude_num").alias("lat"),
                                                   F.greatest(weight, F.lit(1.0)).alias("heat_weight"))
                                       ).filter("lon is not null and lat is not null")


def heat_cells(points: DataFrame, weight: str, degrees: float = 0.005, lon: str = "longitude_num",
               lat: str = "latitude_num") -> DataFrame:
    """Weight per degree cell."""
    return points.filter(number_or(F.col(weight)) > 0).groupBy(
        F.floor(F.col(lon) / degrees).alias("cell_lon"), F.floor(F.col(lat) / degrees).alias("cell_lat")).agg(
        F.sum(number_or(F.col(weight))).alias("heat"))


def heat_breaks(cells: DataFrame) -> DataFrame:
    """Quartile breaks, total, largest cell and number of cells."""
    from corridor_spark.operators.norms import exact_quantiles

    qs = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = exact_quantiles(cells, {"h": (F.col("heat"), qs)})["h"]["q"]
    return cells.agg(*[F.lit(found[q]).alias(f"q{int(q * 100)}") for q in qs], F.sum("heat").alias("total"),
                     F.max("heat").alias("largest"), F.count("heat").alias("cells"))


# --- rollups of a filtered set -----------------------------------------------

ROLLUPS = {
    "date": (("event_date",), ("events", "mentions", "views", "shares", "impact_social")),
    "hour": (("event_hour",), ("events", "mentions", "views", "shares", "impact_social")),
    "department": (("department_norm",), ("events", "mentions", "views", "shares", "impact_social", "avg_metric")),
    "municipality": (("department_norm", "municipality_norm"),
                     ("events", "mentions", "views", "shares", "impact_social", "avg_metric")),
    "source": (("source",), ("events", "mentions", "views", "likes", "shares", "impact_social")),
    "corridor": (("corridor_norm",), ("events", "mentions", "impact_social", "severity_sum", "fatality_events",
                                      "injury_events", "vulnerable_events", "osm_high_medium", "review_events",
                                      "unresolved_events", "avg_distance_m")),
}


def rollup(events: DataFrame, name: str) -> DataFrame:
    keys, wanted = ROLLUPS[name]
    if name == "corridor":
        events = events.filter(F.trim(text_or_blank(F.col("corridor_norm"))) != "")
    known = measures()
    return events.groupBy(*keys).agg(*[known[m].alias(m) for m in wanted])


def corridor_criticality(rolled: DataFrame, critical: DataFrame) -> DataFrame:
    """Corridor rollup with its criticality score."""
    return rolled.join(critical.select("corridor_norm", "corridor_criticality_score"), "corridor_norm", "left")


def counters(events: DataFrame) -> DataFrame:
    """Match, resolution and coordinate counters of a filtered set."""
    good = F.col("osm_match_status").isin(*GOOD_MATCH)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return metric_rows(events, [
        ("osm_alto_medio", n(good)), ("sin_coordenada_osm", n(F.col("osm_match_status") == "NO_COORDINATE_FOR_OSM")),
        ("con_corredor", n(F.trim(text_or_blank(F.col("corridor_norm"))) != "")),
        ("sin_resolver", n(F.col("text_osm_resolution") == "UNRESOLVED")),
        ("severos", n(F.col("severity_class").isin("FATALITY_REPORTED", "INJURY_REPORTED"))),
        ("coordenadas_validas", n(F.col("coordinate_inside_sv_bbox"))),
        ("coordenadas_repetidas", n(F.col("repeated_coordinate_flag"))),
        ("sin_coordenada", n(F.col("coordinate_quality_status") == "MISSING_POINT")),
        ("distancia_media", F.avg(F.when(good, F.col("nearest_osm_distance_m"))), False),
        ("tipos_de_via", F.countDistinct("nearest_osm_road_type"), False)], F.count(F.lit(1)))


def alert_window_groups(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_group").agg(
        F.count("uuid").alias("alerts"), F.sum("cluster_report_count").alias("reports"),
        F.sum("alert_impact_score").alias("impact"), F.count_if("is_critical_alert").alias("critical"))


def readable_counts(df: DataFrame, col: str, labels: dict[str, str], name: str = "eventos") -> DataFrame:
    """Counts per value under its shown label."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias(name))
    return counts.select(label(F.col(col), labels).alias("categoria"), name)


def detail_rows(alerts: DataFrame, news: DataFrame) -> DataFrame:
    """Visible alerts and news in one detail table."""
    a = alerts.select(F.lit("Waze Alert").alias("fuente"), F.col("uuid").cast("string").alias("uuid"), "minute", "alert_group",
                      "city", "street", "corridor_norm_alert", "alert_impact_score", "osm_match_status")
    n = news.select(F.lit("Noticia/incidente").alias("fuente"), F.col("uuid").cast("string").alias("uuid"), "minute", "incident",
                    "department_norm", "municipality_norm", "address", "corridor_norm", "mentions", "impact_social_score",
                    "osm_match_status")
    return a.unionByName(n, allowMissingColumns=True).withColumn("minute_label", minute_label(F.col("minute")))


def top_segments(segs: DataFrame, summary: DataFrame, key: str, metric: str, n: int, percentile: float = 0.0) -> DataFrame:
    """Segments of the ``n`` strongest corridors at or above a percentile of the metric."""
    from corridor_spark.operators.norms import exact_quantiles

    ranked = summary.groupBy(F.col(key).alias("road_key_norm")).agg(F.max(metric).alias(metric))
    if percentile:
        edge = exact_quantiles(ranked, {"m": (F.col(metric), [percentile])})["m"]["q"][percentile]
        ranked = ranked.filter(F.col(metric) >= F.lit(edge))
    return segs.join(ranked.orderBy(F.desc(metric), "road_key_norm").limit(n), "road_key_norm")


# --- review extracts and labels ----------------------------------------------


def review_extracts(events: DataFrame) -> dict[str, DataFrame]:
    """Events outside the country, on a shared coordinate, and without a point."""
    return {
        "outside": events.filter(F.col("coordinate_quality_status") == "OUTSIDE_EL_SALVADOR_BBOX"),
        "repeated": events.filter("repeated_coordinate_flag"),
        "missing": events.filter(F.col("coordinate_quality_status") == "MISSING_POINT"),
    }


def label_segments(segs: DataFrame, matches: DataFrame, n: int = 12) -> DataFrame:
    """Longest segment of each of the ``n`` strongest accepted or reviewed road matches, to carry its label."""
    chosen = matches.filter(F.col("match_status").isin("TEXT_MATCH_ACCEPTED", "TEXT_MATCH_REVIEW")).orderBy(
        F.desc("events"), F.desc("text_match_score"), "corridor").limit(n)
    longest = segs.join(chosen.select(F.col("matched_road_key_norm").alias("road_key_norm")), "road_key_norm", "left_semi").groupBy(
        "road_key_norm").agg(F.max_by("osm_way_id", F.struct("length_m", "osm_way_id")).alias("osm_way_id"))
    return chosen.select(F.initcap("corridor").alias("label"), F.col("matched_road_key_norm").alias("road_key_norm")).join(
        longest, "road_key_norm")
