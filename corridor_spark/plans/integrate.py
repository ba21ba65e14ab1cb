"""Alerts × jams on the dense corridor-hour grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import clip, rounded, safe_divide
from corridor_spark.functions.text import clean_corridor, corridor_key
from corridor_spark.lexicons import HOURS_PER_DAY
from corridor_spark.operators.norms import exact_quantiles, fit_robust, weighted
from corridor_spark.operators.ranks import correlations
from corridor_spark.operators.tables import metric_rows
from corridor_spark.plans.jams import _is
from corridor_spark.session import stage

UNRESOLVED = "unresolved"
JAM_MEASURES = ("jam_count", "jam_records_count", "jam_delay_total", "jam_congestion_load", "jam_intensity_total",
                "jam_intensity_avg", "severe_jam_count", "extreme_jam_count", "speed_collapse_count",
                "jam_match_confidence_avg", "jam_estimation_stability_avg", "jam_avg_speed", "jam_min_speed")
ALERT_MEASURES = ("alert_count", "alert_reports_count", "alert_impact_total", "alert_impact_avg", "alert_severity_avg",
                  "alert_reliability_avg", "critical_alert_count", "safety_alert_count", "operational_alert_count",
                  "accident_count", "closure_count", "hazard_count", "stopped_traffic_alert_count",
                  "heavy_traffic_alert_count", "spatial_confidence_alerts", "alert_corridor_match_confidence_avg")


def crosswalk(jam_summary: DataFrame, alert_summary: DataFrame) -> DataFrame:
    """One row per corridor key with the names and totals of both sources."""
    jams = jam_summary.withColumn("corridor_key", corridor_key(F.col("corridor_norm"))).groupBy("corridor_key").agg(
        F.min("corridor_norm").alias("corridor_name_jams"),
        F.sum("jams_count_total").alias("jams_count_total"),
        F.sum("jam_intensity_total").alias("jam_intensity_total"),
        F.max("corridor_jam_pressure_score").alias("corridor_jam_pressure_score"),
    )
    alerts = alert_summary.withColumn("corridor_key", corridor_key(F.col("corridor_norm_alert"))).groupBy(
        "corridor_key"
    ).agg(
        F.min("corridor_norm_alert").alias("corridor_name_alerts"),
        F.sum("alerts_count_total").alias("alerts_count_total"),
        F.sum("corridor_alert_impact").alias("corridor_alert_impact"),
        F.max("corridor_alert_pressure").alias("corridor_alert_pressure"),
    )
    both = jams.join(alerts, "corridor_key", "full_outer")
    name = F.coalesce("corridor_name_alerts", "corridor_name_jams", F.lit("UNRESOLVED"))
    numbers = ("jams_count_total", "jam_intensity_total", "corridor_jam_pressure_score", "alerts_count_total",
               "corridor_alert_impact", "corridor_alert_pressure")
    return both.withColumn(
        "corridor_name", F.when(F.col("corridor_key") == UNRESOLVED, "UNRESOLVED").otherwise(name)
    ).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers}).withColumns(
        {"has_jams": F.col("jams_count_total") > 0, "has_alerts": F.col("alerts_count_total") > 0}
    )


def jams_by_hour(jams: DataFrame) -> DataFrame:
    key = corridor_key(clean_corridor(F.col("corridor_norm_group")))
    return jams.groupBy(key.alias("corridor_key"), "event_hour").agg(
        F.count(F.lit(1)).alias("jam_count"),
        F.sum("records_per_uuid").alias("jam_records_count"),
        F.sum("delay_min").alias("jam_delay_total"),
        F.sum("congestion_load").alias("jam_congestion_load"),
        F.sum("jam_intensity_score").alias("jam_intensity_total"),
        F.avg("jam_intensity_score").alias("jam_intensity_avg"),
        F.count_if("severe_jam_flag").alias("severe_jam_count"),
        F.count_if("extreme_jam_flag").alias("extreme_jam_count"),
        F.count_if("speed_collapse_flag").alias("speed_collapse_count"),
        F.avg("corridor_match_confidence_score").alias("jam_match_confidence_avg"),
        F.avg("jam_estimation_stability").alias("jam_estimation_stability_avg"),
        F.avg("speed_mean").alias("jam_avg_speed"),
        F.min("speed_min").alias("jam_min_speed"),
    )


def alerts_by_hour(alerts: DataFrame) -> DataFrame:
    key = corridor_key(clean_corridor(F.col("corridor_norm_alert_group")))
    return alerts.groupBy(key.alias("corridor_key"), "event_hour").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.sum("cluster_report_count").alias("alert_reports_count"),
        F.sum("alert_impact_score").alias("alert_impact_total"),
        F.avg("alert_impact_score").alias("alert_impact_avg"),
        F.avg("severity_proxy").alias("alert_severity_avg"),
        F.avg("alert_reliability_proxy").alias("alert_reliability_avg"),
        F.count_if("is_critical_alert").alias("critical_alert_count"),
        F.count_if("is_safety_alert").alias("safety_alert_count"),
        F.count_if("is_operational_alert").alias("operational_alert_count"),
        _is("alert_group", "ACCIDENTE").alias("accident_count"),
        _is("alert_group", "CIERRE_VIAL").alias("closure_count"),
        _is("type", "HAZARD").alias("hazard_count"),
        _is("alert_group", "TRAFICO_DETENIDO").alias("stopped_traffic_alert_count"),
        _is("alert_group", "TRAFICO_PESADO").alias("heavy_traffic_alert_count"),
        F.avg("osm_spatial_confidence_score").alias("spatial_confidence_alerts"),
        F.avg("corridor_match_confidence_score").alias("alert_corridor_match_confidence_avg"),
    )


def dense_panel(jam_hours: DataFrame, alert_hours: DataFrame, keys: DataFrame) -> DataFrame:
    """Every corridor × 24 hours with both sources' measures (0 where absent), neighbours and flags."""
    grid = keys.select("corridor_key", "corridor_name").withColumn(
        "event_hour", F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_DAY - 1)))
    )
    on = ["corridor_key", "event_hour"]
    panel = grid.join(jam_hours, on, "left").join(alert_hours, on, "left")
    panel = panel.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in (*JAM_MEASURES, *ALERT_MEASURES)})
    jam, alert = F.col("jam_count") > 0, F.col("alert_count") > 0
    panel = panel.withColumns({"has_jam": jam, "has_alert": alert})
    w = Window.partitionBy("corridor_key").orderBy("event_hour")
    neighbours = {}
    for short, col in (("alert_impact", "alert_impact_total"), ("alert_count", "alert_count"),
                       ("jam_intensity", "jam_intensity_total")):
        zero = F.lit(0)
        neighbours[f"{short}_prev_1h"] = F.coalesce(F.lag(col, 1).over(w), zero)
        neighbours[f"{short}_next_1h"] = F.coalesce(F.lead(col, 1).over(w), zero)
    panel = panel.withColumns(neighbours)
    before, after = F.col("alert_count_prev_1h") > 0, F.col("alert_count_next_1h") > 0
    has_jam, has_alert = F.col("has_jam"), F.col("has_alert")
    return panel.withColumns(
        {
            "alert_jam_same_hour_flag": has_jam & has_alert,
            "jam_without_alert_flag": has_jam & ~has_alert,
            "alert_without_jam_flag": has_alert & ~has_jam,
            "alert_to_jam_ratio": F.least(safe_divide(F.col("alert_count"), F.col("jam_count")), F.lit(10.0)),
            "alert_leads_jam_1h_flag": has_jam & before,
            "alert_lags_jam_1h_flag": has_jam & after,
            "alert_jam_pm1h_window_flag": has_jam & (has_alert | before | after),
        }
    )


def _flag(col: str) -> Column:
    return F.col(col).cast("double")


def score_panel(panel: DataFrame) -> DataFrame:
    """Congestion, alert, alignment, reliability and integrated scores per corridor-hour. Pass a staged panel."""
    closures = F.col("accident_count") + F.col("closure_count")
    norms = fit_robust(
        panel,
        {"jam_intensity_total": 0.95, "jam_delay_total": 0.95, "jam_congestion_load": 0.95, "jam_count": 0.95,
         "severe_jam_count": 1.0, "alert_impact_total": 0.95, "alert_count": 0.95, "critical_alert_count": 1.0,
         "alert_reports_count": 0.95, "_closures": 1.0},
        {"_closures": closures},
    )
    panel = panel.withColumns(
        {
            "operational_congestion_pressure": rounded(100 * weighted([
                (0.30, norms.of("jam_intensity_total")), (0.25, norms.of("jam_delay_total")),
                (0.20, norms.of("jam_congestion_load")), (0.15, norms.of("jam_count")),
                (0.10, norms.of("severe_jam_count"))]), 4),
            "critical_alert_pressure": rounded(100 * weighted([
                (0.35, norms.of("alert_impact_total")), (0.25, norms.of("alert_count")),
                (0.20, norms.of("critical_alert_count")), (0.10, norms.of("alert_reports_count")),
                (0.10, norms.of("_closures", closures))]), 4),
            "temporal_alignment_score": rounded(100 * weighted([
                (0.55, _flag("alert_jam_same_hour_flag")), (0.25, _flag("alert_leads_jam_1h_flag")),
                (0.20, _flag("alert_lags_jam_1h_flag"))]), 4),
            "integrated_reliability_score": rounded(100 * weighted([
                (0.35, F.col("jam_match_confidence_avg")), (0.25, F.col("spatial_confidence_alerts")),
                (0.20, F.col("alert_corridor_match_confidence_avg")),
                (0.20, F.col("jam_estimation_stability_avg"))]), 4),
        }
    )
    total = rounded(weighted([
        (0.45, F.col("operational_congestion_pressure")), (0.35, F.col("critical_alert_pressure")),
        (0.12, F.col("temporal_alignment_score")), (0.08, F.col("integrated_reliability_score"))]), 4)
    both = F.col("critical_alert_pressure") + F.col("operational_congestion_pressure") + 1e-9
    return panel.withColumns(
        {
            "integrated_corridor_hour_pressure": F.when(F.col("corridor_key") == UNRESOLVED, 0.0).otherwise(total),
            "explanatory_alert_share": rounded(F.col("critical_alert_pressure") / both, 4),
            "data_quality_flags": F.array_join(F.array_compact(F.array(
                F.when(F.col("corridor_key") == UNRESOLVED, "UNRESOLVED_CORRIDOR"),
                F.when(F.col("jam_without_alert_flag"), "JAM_WITHOUT_ALERT"),
                F.when(F.col("alert_without_jam_flag"), "ALERT_WITHOUT_JAM"),
                F.when((F.col("integrated_reliability_score") < 35) & (F.col("has_jam") | F.col("has_alert")),
                       "LOW_INTEGRATED_RELIABILITY"))), ";"),
        }
    )


def quadrant(jam: Column, alert: Column, jam_edge: float, alert_edge: float) -> Column:
    high_jam, high_alert = jam >= jam_edge, alert >= alert_edge
    return (
        F.when(high_jam & high_alert, "ALTA_CONGESTION_ALTAS_ALERTAS")
        .when(high_jam, "ALTA_CONGESTION_BAJAS_ALERTAS")
        .when(high_alert, "BAJA_CONGESTION_ALTAS_ALERTAS")
        .otherwise("BAJA_CONGESTION_BAJAS_ALERTAS")
    )


def priority() -> Column:
    total, coupling = F.col("integrated_corridor_pressure"), F.col("corridor_event_congestion_coupling")
    jam, alert = F.col("jam_pressure_norm"), F.col("alert_pressure_norm")
    return (
        F.when(F.col("corridor_key") == UNRESOLVED, "NO_PRIORIZAR_SIN_CORREDOR")
        .when((total >= 75) & (coupling >= 45), "CRITICO_INTEGRADO")
        .when((jam >= 70) & (alert < 35), "CONGESTION_NO_EXPLICADA_POR_ALERTS")
        .when((alert >= 70) & (jam < 35), "EVENTOS_SIN_CONGESTION_PROPORCIONAL")
        .when(total >= 55, "PRIORIDAD_MEDIA_ALTA")
        .when(coupling >= 45, "ACOPLAMIENTO_RELEVANTE")
        .otherwise("OBSERVACION_COMPLEMENTARIA")
    )


def summary_totals(panel: DataFrame) -> DataFrame:
    """Sums, active hours and rates per corridor."""
    n_if = lambda c: F.count_if(F.col(c))
    s = panel.groupBy("corridor_key", "corridor_name").agg(
        F.sum("jam_count").alias("jam_count_total"),
        F.sum("jam_delay_total").alias("jam_delay_total"),
        F.sum("jam_congestion_load").alias("jam_congestion_load_total"),
        F.sum("jam_intensity_total").alias("jam_intensity_total"),
        F.sum("severe_jam_count").alias("severe_jam_count_total"),
        F.sum("speed_collapse_count").alias("speed_collapse_count_total"),
        F.sum("alert_count").alias("alert_count_total"),
        F.sum("alert_reports_count").alias("alert_reports_total"),
        F.sum("alert_impact_total").alias("alert_impact_total"),
        F.sum("critical_alert_count").alias("critical_alert_count_total"),
        F.sum("accident_count").alias("accident_count_total"),
        F.sum("closure_count").alias("closure_count_total"),
        F.sum("hazard_count").alias("hazard_count_total"),
        F.sum("stopped_traffic_alert_count").alias("stopped_traffic_alert_count_total"),
        n_if("alert_jam_same_hour_flag").alias("same_hour_overlap_count"),
        n_if("alert_leads_jam_1h_flag").alias("alert_leads_jam_1h_count"),
        n_if("alert_lags_jam_1h_flag").alias("alert_lags_jam_1h_count"),
        n_if("alert_jam_pm1h_window_flag").alias("pm1h_window_overlap_count"),
        n_if("jam_without_alert_flag").alias("jam_without_alert_hours"),
        n_if("alert_without_jam_flag").alias("alert_without_jam_hours"),
        F.sum("integrated_corridor_hour_pressure").alias("integrated_pressure_total"),
        F.max("integrated_corridor_hour_pressure").alias("integrated_pressure_max"),
        F.avg("temporal_alignment_score").alias("temporal_alignment_avg"),
        F.avg("integrated_reliability_score").alias("reliability_avg"),
        n_if("has_jam").alias("jam_active_hours"),
        n_if("has_alert").alias("alert_active_hours"),
        F.count_if(F.col("has_jam") | F.col("has_alert")).alias("integrated_active_hours"),
    )
    return s.withColumns(
        {
            "same_hour_overlap_rate": rounded(
                safe_divide(F.col("same_hour_overlap_count"), F.col("integrated_active_hours")), 4),
            "jam_hours_explained_same_hour_rate": rounded(
                safe_divide(F.col("same_hour_overlap_count"), F.col("jam_active_hours")), 4),
            "jam_hours_with_alert_pm1h_rate": rounded(
                safe_divide(F.col("pm1h_window_overlap_count"), F.col("jam_active_hours")), 4),
            "alert_to_jam_ratio_total": rounded(
                F.least(safe_divide(F.col("alert_count_total"), F.col("jam_count_total")), F.lit(10.0)), 4),
        }
    )


def corridor_summary(panel: DataFrame) -> DataFrame:
    """Integrated pressure, coupling, quadrant and priority per corridor."""
    s = stage(summary_totals(panel), "integrated-totals")
    norms = fit_robust(
        s,
        {"alert_impact_total": 0.95, "jam_intensity_total": 0.95, "jam_delay_total": 0.95,
         "jam_congestion_load_total": 0.95, "jam_active_hours": 1.0, "alert_count_total": 0.95,
         "critical_alert_count_total": 1.0, "alert_active_hours": 1.0, "same_hour_overlap_count": 1.0,
         "integrated_pressure_total": 0.95},
    )
    impact, intensity = norms.of("alert_impact_total"), norms.of("jam_intensity_total")
    s = s.withColumns(
        {
            "explanatory_alert_share": rounded(impact / (impact + intensity + 1e-9), 4),
            "jam_pressure_norm": rounded(100 * weighted([
                (0.35, intensity), (0.25, norms.of("jam_delay_total")), (0.20, norms.of("jam_congestion_load_total")),
                (0.20, norms.of("jam_active_hours"))]), 4),
            "alert_pressure_norm": rounded(100 * weighted([
                (0.35, impact), (0.25, norms.of("alert_count_total")), (0.20, norms.of("critical_alert_count_total")),
                (0.20, norms.of("alert_active_hours"))]), 4),
        }
    )
    jam, alert = F.col("jam_pressure_norm"), F.col("alert_pressure_norm")
    balance = clip(1 - F.abs(jam - alert) / (jam + alert + 1e-9), 0, 1)
    s = s.withColumn(
        "corridor_event_congestion_coupling",
        rounded(100 * weighted([
            (0.30, F.col("same_hour_overlap_rate")), (0.25, F.col("jam_hours_with_alert_pm1h_rate")),
            (0.20, balance), (0.15, norms.of("same_hour_overlap_count")),
            (0.10, norms.of("critical_alert_count_total"))]), 4),
    )
    total = rounded(weighted([
        (0.40, jam), (0.35, alert), (0.15, F.col("corridor_event_congestion_coupling")),
        (0.10, norms.of("integrated_pressure_total") * 100)]), 4)
    s = stage(s.withColumn(
        "integrated_corridor_pressure", F.when(F.col("corridor_key") == UNRESOLVED, 0.0).otherwise(total)
    ), "integrated-scores")
    edges = exact_quantiles(
        s.filter(F.col("corridor_key") != UNRESOLVED), {"jam": (jam, [0.75]), "alert": (alert, [0.75])}
    )
    return s.withColumns(
        {
            "quadrant": quadrant(jam, alert, edges["jam"]["q"][0.75] or 0.0, edges["alert"]["q"][0.75] or 0.0),
            "integration_priority": priority(),
        }
    )


def hourly_summary(panel: DataFrame) -> DataFrame:
    """Totals per hour over all corridors with the same-hour overlap share."""
    h = panel.groupBy("event_hour").agg(
        *[F.sum(c).alias(c) for c in ("jam_count", "jam_delay_total", "jam_intensity_total", "alert_count",
                                      "alert_impact_total", "critical_alert_count")],
        F.count_if("alert_jam_same_hour_flag").alias("same_hour_overlap_count"),
        F.count_if("jam_without_alert_flag").alias("jam_without_alert_hours"),
        F.count_if("alert_without_jam_flag").alias("alert_without_jam_hours"),
        F.sum("integrated_corridor_hour_pressure").alias("integrated_pressure_total"),
    )
    active = F.col("same_hour_overlap_count") + F.col("jam_without_alert_hours") + F.col("alert_without_jam_hours")
    return h.withColumn(
        "same_hour_overlap_share", rounded(safe_divide(F.col("same_hour_overlap_count"), active), 4)
    )


def lag_analysis(panel: DataFrame, lags=(-2, -1, 0, 1, 2)) -> DataFrame:
    """Correlation of alert impact with jam intensity when alerts are shifted by some hours.

    All lags are one table with the lag as a group, so the panel is read once.
    """
    w = Window.partitionBy("corridor_key").orderBy("event_hour")
    active = panel.filter(F.col("corridor_key") != UNRESOLVED)
    shifted = active.select(
        F.col("jam_intensity_total").alias("jam"),
        F.array(*[
            F.struct(F.lit(lag).alias("lag"),
                     F.coalesce(F.lag("alert_impact_total", -lag).over(w), F.lit(0.0)).alias("alert"))
            for lag in lags
        ]).alias("_l"),
    ).select("jam", F.explode("_l").alias("_s")).select(
        F.col("_s.lag").alias("lag_hours_alert_vs_jam"), F.col("_s.alert").alias("alert"), "jam"
    ).filter((F.col("jam") > 0) | (F.col("alert") > 0))
    lag = F.col("lag_hours_alert_vs_jam")
    return correlations(shifted, "alert", "jam", ["lag_hours_alert_vs_jam"]).select(
        lag,
        F.when(lag < 0, "alert_before_jam").when(lag == 0, "same_hour").otherwise("alert_after_jam")
        .alias("interpretation"),
        F.col("n_rows").alias("n_active_rows"),
        F.col("pearson").alias("pearson_alert_impact_vs_jam_intensity"),
        F.col("spearman").alias("spearman_alert_impact_vs_jam_intensity"),
    )


def correlation_pairs(panel: DataFrame, summary: DataFrame) -> DataFrame:
    """Pearson and Spearman of alert and jam measures per corridor-hour and per corridor."""
    levels = (
        ("corridor_hour", panel.filter((F.col("jam_count") > 0) | (F.col("alert_count") > 0)),
         (("alert_impact_total", "jam_intensity_total"), ("critical_alert_count", "jam_delay_total"),
          ("alert_count", "jam_count"))),
        ("corridor_day", summary,
         (("alert_impact_total", "jam_intensity_total"), ("critical_alert_count_total", "jam_delay_total"),
          ("alert_count_total", "jam_count_total"))),
    )
    stacked = None
    for level, df, pairs in levels:
        rows = df.filter(F.col("corridor_key") != UNRESOLVED).select(
            F.explode(F.array(*[
                F.struct(F.lit(level).alias("analysis_level"), F.lit(x).alias("x_variable"), F.lit(y).alias("y_variable"),
                         F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                for x, y in pairs])).alias("_p")
        ).select("_p.*").filter((F.col("x") > 0) | (F.col("y") > 0))
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return correlations(stacked, "x", "y", ["analysis_level", "x_variable", "y_variable"])


def quality_metrics(jams: DataFrame, alerts: DataFrame, panel: DataFrame, summary: DataFrame, lags: DataFrame,
                    correlation: DataFrame) -> DataFrame:
    """Counts that describe the integration, as metric rows."""
    known = F.col("corridor_key") != UNRESOLVED
    has_jam, has_alert = F.col("jam_count_total") > 0, F.col("alert_count_total") > 0
    best = lags.orderBy(F.desc("pearson_alert_impact_vs_jam_intensity"), "lag_hours_alert_vs_jam").limit(1)
    main = correlation.filter((F.col("analysis_level") == "corridor_hour") & (F.col("x_variable") == "alert_impact_total"))
    parts = [
        metric_rows(jams, [("jams_unique", F.countDistinct("uuid"))]),
        metric_rows(alerts, [("alerts_unique", F.countDistinct("uuid"))]),
        metric_rows(summary, [
            ("corridor_keys_total", F.countDistinct("corridor_key")),
            ("common_corridors_alerts_jams", F.count_if(known & has_jam & has_alert)),
            ("only_jams_corridors", F.count_if(known & has_jam & ~has_alert)),
            ("only_alerts_corridors", F.count_if(known & ~has_jam & has_alert))]),
        metric_rows(panel, [
            ("corridor_hour_rows", F.count(F.lit(1))),
            ("active_corridor_hour_rows", F.count_if(F.col("has_jam") | F.col("has_alert"))),
            ("same_hour_overlap_rows", F.count_if("alert_jam_same_hour_flag")),
            ("jam_without_alert_rows", F.count_if("jam_without_alert_flag")),
            ("alert_without_jam_rows", F.count_if("alert_without_jam_flag"))]),
        metric_rows(best, [("best_lag_pearson", F.max("lag_hours_alert_vs_jam"))]),
        metric_rows(main, [("corridor_hour_alert_impact_jam_intensity_pearson", F.max("pearson"))]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def temporal_state() -> Column:
    jam, alert = F.coalesce("has_jam", F.lit(False)), F.coalesce("has_alert", F.lit(False))
    return (
        F.when(jam & alert, "ALERTS_JAMS").when(jam, "JAMS_ONLY").when(alert, "ALERTS_ONLY").otherwise("NO_ACTIVITY")
    )
