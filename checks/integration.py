"""Integration queries: alerts × jams."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks.alerts import ALERT_SUMMARY
from checks.registry import add
from checks.sql import JAM_SUMMARY, norm, tcompact, wsum
from corridor_spark.operators.tables import top_rows
from corridor_spark.plans import integrate

# The jam CTEs, then the alert CTEs without the roads and aliases both start with, under other resolution names.
_tail = ALERT_SUMMARY[ALERT_SUMMARY.index("alert AS ("):]
for _name in ("t0", "t1", "t2", "t3", "t4", "t5", "ah", "rh", "resolved"):
    _tail = re.sub(rf"\b{_name}\b", f"a_{_name}", _tail)
BOTH = f"{JAM_SUMMARY}, {_tail}"


def _key(col: str) -> str:
    return f"CASE WHEN {tcompact(col)} = '' THEN 'unresolved' ELSE {tcompact(col)} END"


CROSSWALK = f"""{BOTH},
xj AS (SELECT {_key('corridor_norm')} AS corridor_key, min(corridor_norm) AS corridor_name_jams, CAST(sum(jams_count_total) AS BIGINT) AS jams_count_total,
              sum(jam_intensity_total) AS jam_intensity_total, max(corridor_jam_pressure_score) AS corridor_jam_pressure_score FROM jam_summary GROUP BY 1),
xa AS (SELECT {_key('corridor_norm_alert')} AS corridor_key, min(corridor_norm_alert) AS corridor_name_alerts, CAST(sum(alerts_count_total) AS BIGINT) AS alerts_count_total,
              sum(corridor_alert_impact) AS corridor_alert_impact, max(corridor_alert_pressure) AS corridor_alert_pressure FROM alert_summary GROUP BY 1),
crosswalk AS (SELECT corridor_key, CASE WHEN corridor_key = 'unresolved' THEN 'UNRESOLVED' ELSE COALESCE(corridor_name_alerts, corridor_name_jams) END AS corridor_name,
              COALESCE(jams_count_total, 0) AS jams_count_total, COALESCE(jam_intensity_total, 0) AS jam_intensity_total,
              COALESCE(corridor_jam_pressure_score, 0) AS corridor_jam_pressure_score, COALESCE(alerts_count_total, 0) AS alerts_count_total,
              COALESCE(corridor_alert_impact, 0) AS corridor_alert_impact, COALESCE(corridor_alert_pressure, 0) AS corridor_alert_pressure,
              COALESCE(jams_count_total, 0) > 0 AS has_jams, COALESCE(alerts_count_total, 0) > 0 AS has_alerts
              FROM xj FULL OUTER JOIN xa USING (corridor_key))"""

add("crosswalk", "corridor_key corridor_name jams_count_total jam_intensity_total:4 corridor_jam_pressure_score:4 alerts_count_total "
    "corridor_alert_impact:4 corridor_alert_pressure:4 has_jams has_alerts", lambda x: x.crosswalk, CROSSWALK, "crosswalk")

PANEL = f"""{CROSSWALK},
jh AS (SELECT {_key('corridor_norm_group')} AS corridor_key, event_hour, count(*) AS jam_count, CAST(sum(records_per_uuid) AS BIGINT) AS jam_records_count, sum(delay_min) AS jam_delay_total,
              sum(congestion_load) AS jam_congestion_load, sum(jam_intensity_score) AS jam_intensity_total, count(*) FILTER (severe_jam_flag) AS severe_jam_count,
              avg(corridor_match_confidence_score) AS jam_match_confidence_avg, avg(jam_estimation_stability) AS jam_estimation_stability_avg,
              count(*) FILTER (speed_collapse_flag) AS speed_collapse_count
       FROM jams GROUP BY 1, 2),
ahr AS (SELECT {_key('corridor_norm_alert_group')} AS corridor_key, event_hour, count(*) AS alert_count, CAST(sum(cluster_report_count) AS BIGINT) AS alert_reports_count, sum(alert_impact_score) AS alert_impact_total,
              count(*) FILTER (is_critical_alert) AS critical_alert_count, count(*) FILTER (alert_group = 'ACCIDENTE') AS accident_count,
              count(*) FILTER (alert_group = 'CIERRE_VIAL') AS closure_count, count(*) FILTER (type = 'HAZARD') AS hazard_count,
              count(*) FILTER (alert_group = 'TRAFICO_DETENIDO') AS stopped_traffic_alert_count,
              avg(osm_spatial_confidence_score) AS spatial_confidence_alerts, avg(corridor_match_confidence_score) AS alert_corridor_match_confidence_avg
       FROM alerts GROUP BY 1, 2),
pn0 AS (SELECT k.corridor_key, k.corridor_name, CAST(k.h AS INT) AS event_hour,
        {', '.join(f'COALESCE({c}, 0) AS {c}' for c in ('jam_count', 'jam_records_count', 'jam_delay_total', 'jam_congestion_load', 'jam_intensity_total', 'severe_jam_count', 'speed_collapse_count', 'jam_match_confidence_avg', 'jam_estimation_stability_avg', 'alert_count', 'alert_reports_count', 'alert_impact_total', 'critical_alert_count', 'accident_count', 'closure_count', 'hazard_count', 'stopped_traffic_alert_count', 'spatial_confidence_alerts', 'alert_corridor_match_confidence_avg'))}
        FROM (SELECT corridor_key, corridor_name, h FROM crosswalk, range(24) t(h)) k
        LEFT JOIN jh ON jh.corridor_key = k.corridor_key AND jh.event_hour = k.h LEFT JOIN ahr ON ahr.corridor_key = k.corridor_key AND ahr.event_hour = k.h),
pn1 AS (SELECT *, jam_count > 0 AS has_jam, alert_count > 0 AS has_alert,
        COALESCE(lag(alert_count) OVER w, 0) AS alert_count_prev_1h, COALESCE(lead(alert_count) OVER w, 0) AS alert_count_next_1h,
        COALESCE(lag(alert_impact_total) OVER w, 0) AS alert_impact_prev_1h, COALESCE(lead(jam_intensity_total) OVER w, 0) AS jam_intensity_next_1h
        FROM pn0 WINDOW w AS (PARTITION BY corridor_key ORDER BY event_hour)),
pn2 AS (SELECT *, has_jam AND has_alert AS alert_jam_same_hour_flag, has_jam AND NOT has_alert AS jam_without_alert_flag, has_alert AND NOT has_jam AS alert_without_jam_flag,
        CASE WHEN jam_count = 0 THEN 0 ELSE LEAST(alert_count / CAST(jam_count AS DOUBLE), 10) END AS alert_to_jam_ratio,
        has_jam AND alert_count_prev_1h > 0 AS alert_leads_jam_1h_flag, has_jam AND alert_count_next_1h > 0 AS alert_lags_jam_1h_flag,
        has_jam AND (has_alert OR alert_count_prev_1h > 0 OR alert_count_next_1h > 0) AS alert_jam_pm1h_window_flag FROM pn1),
pn3 AS (SELECT *, ROUND(100 * {wsum((.30, norm('jam_intensity_total')), (.25, norm('jam_delay_total')), (.20, norm('jam_congestion_load')), (.15, norm('CAST(jam_count AS DOUBLE)')), (.10, norm('CAST(severe_jam_count AS DOUBLE)', 1.0)))}, 4) AS operational_congestion_pressure,
        ROUND(100 * {wsum((.35, norm('alert_impact_total')), (.25, norm('CAST(alert_count AS DOUBLE)')), (.20, norm('CAST(critical_alert_count AS DOUBLE)', 1.0)), (.10, norm('CAST(alert_reports_count AS DOUBLE)')), (.10, norm('CAST(accident_count + closure_count AS DOUBLE)', 1.0)))}, 4) AS critical_alert_pressure,
        ROUND(100 * (0.55e0*CAST(alert_jam_same_hour_flag AS INT) + 0.25e0*CAST(alert_leads_jam_1h_flag AS INT) + 0.20e0*CAST(alert_lags_jam_1h_flag AS INT)), 4) AS temporal_alignment_score,
        ROUND(100 * {wsum((.35, 'jam_match_confidence_avg'), (.25, 'spatial_confidence_alerts'), (.20, 'alert_corridor_match_confidence_avg'), (.20, 'jam_estimation_stability_avg'))}, 4) AS integrated_reliability_score
        FROM pn2),
panel AS (SELECT *, CASE WHEN corridor_key = 'unresolved' THEN 0e0 ELSE ROUND({wsum((.45, 'operational_congestion_pressure'), (.35, 'critical_alert_pressure'), (.12, 'temporal_alignment_score'), (.08, 'integrated_reliability_score'))}, 4) END AS integrated_corridor_hour_pressure,
        ROUND(critical_alert_pressure / (critical_alert_pressure + operational_congestion_pressure + 1e-9), 4) AS explanatory_alert_share,
        array_to_string(list_filter([CASE WHEN corridor_key = 'unresolved' THEN 'UNRESOLVED_CORRIDOR' END, CASE WHEN jam_without_alert_flag THEN 'JAM_WITHOUT_ALERT' END,
          CASE WHEN alert_without_jam_flag THEN 'ALERT_WITHOUT_JAM' END, CASE WHEN integrated_reliability_score < 35 AND (has_jam OR has_alert) THEN 'LOW_INTEGRATED_RELIABILITY' END], lambda x: x IS NOT NULL), ';') AS data_quality_flags
        FROM pn3)"""

add("dense_panel", "corridor_key event_hour jam_count alert_count alert_to_jam_ratio:4 alert_count_prev_1h alert_count_next_1h alert_impact_prev_1h:4 "
    "jam_intensity_next_1h:4 alert_jam_same_hour_flag alert_leads_jam_1h_flag alert_lags_jam_1h_flag alert_jam_pm1h_window_flag "
    "operational_congestion_pressure:4 critical_alert_pressure:4 temporal_alignment_score:4 integrated_reliability_score:4 "
    "integrated_corridor_hour_pressure:4 explanatory_alert_share:4 data_quality_flags", lambda x: x.panel, PANEL, "panel")

_SUMS = {
    "jam_count_total": "CAST(sum(jam_count) AS DOUBLE)", "jam_delay_total": "sum(jam_delay_total)", "jam_congestion_load_total": "sum(jam_congestion_load)",
    "jam_intensity_total": "sum(jam_intensity_total)", "alert_count_total": "CAST(sum(alert_count) AS DOUBLE)", "alert_impact_total": "sum(alert_impact_total)",
    "critical_alert_count_total": "CAST(sum(critical_alert_count) AS DOUBLE)", "same_hour_overlap_count": "CAST(count(*) FILTER (alert_jam_same_hour_flag) AS DOUBLE)",
    "pm1h_window_overlap_count": "CAST(count(*) FILTER (alert_jam_pm1h_window_flag) AS DOUBLE)", "jam_active_hours": "CAST(count(*) FILTER (has_jam) AS DOUBLE)",
    "alert_active_hours": "CAST(count(*) FILTER (has_alert) AS DOUBLE)", "integrated_active_hours": "CAST(count(*) FILTER (has_jam OR has_alert) AS DOUBLE)",
    "integrated_pressure_total": "sum(integrated_corridor_hour_pressure)", "integrated_pressure_max": "max(integrated_corridor_hour_pressure)",
    "temporal_alignment_avg": "avg(temporal_alignment_score)", "reliability_avg": "avg(integrated_reliability_score)",
}
_div = lambda a, b: f"ROUND(CASE WHEN {b} = 0 THEN 0e0 ELSE {a}/{b} END, 4)"
SUMMARY = f"""{PANEL},
is0 AS (SELECT corridor_key, corridor_name, {', '.join(f'{v} AS {k}' for k, v in _SUMS.items())} FROM panel GROUP BY 1, 2),
is1 AS (SELECT *, {_div('same_hour_overlap_count', 'integrated_active_hours')} AS same_hour_overlap_rate, {_div('pm1h_window_overlap_count', 'jam_active_hours')} AS jam_hours_with_alert_pm1h_rate,
        ROUND({norm('alert_impact_total')} / ({norm('alert_impact_total')} + {norm('jam_intensity_total')} + 1e-9), 4) AS explanatory_alert_share,
        ROUND(100 * {wsum((.35, norm('jam_intensity_total')), (.25, norm('jam_delay_total')), (.20, norm('jam_congestion_load_total')), (.20, norm('jam_active_hours', 1.0)))}, 4) AS jam_pressure_norm,
        ROUND(100 * {wsum((.35, norm('alert_impact_total')), (.25, norm('alert_count_total')), (.20, norm('critical_alert_count_total', 1.0)), (.20, norm('alert_active_hours', 1.0)))}, 4) AS alert_pressure_norm
        FROM is0),
is2 AS (SELECT *, LEAST(GREATEST(1 - abs(jam_pressure_norm - alert_pressure_norm)/(jam_pressure_norm + alert_pressure_norm + 1e-9), 0), 1) AS bal FROM is1),
is3 AS (SELECT *, ROUND(100 * {wsum((.30, 'same_hour_overlap_rate'), (.25, 'jam_hours_with_alert_pm1h_rate'), (.20, 'bal'), (.15, norm('same_hour_overlap_count', 1.0)), (.10, norm('critical_alert_count_total', 1.0)))}, 4) AS corridor_event_congestion_coupling FROM is2),
is4 AS (SELECT *, CASE WHEN corridor_key = 'unresolved' THEN 0e0 ELSE ROUND({wsum((.40, 'jam_pressure_norm'), (.35, 'alert_pressure_norm'), (.15, 'corridor_event_congestion_coupling'))[:-1]} + 0.1e0 * ({norm('integrated_pressure_total')} * 100)), 4) END AS integrated_corridor_pressure FROM is3),
is5 AS (SELECT *, (SELECT quantile_cont(jam_pressure_norm, .75) FROM is4 WHERE corridor_key <> 'unresolved') AS je, (SELECT quantile_cont(alert_pressure_norm, .75) FROM is4 WHERE corridor_key <> 'unresolved') AS ae FROM is4),
integrated AS (SELECT *, CASE WHEN jam_pressure_norm >= je AND alert_pressure_norm >= ae THEN 'ALTA_CONGESTION_ALTAS_ALERTAS' WHEN jam_pressure_norm >= je THEN 'ALTA_CONGESTION_BAJAS_ALERTAS'
        WHEN alert_pressure_norm >= ae THEN 'BAJA_CONGESTION_ALTAS_ALERTAS' ELSE 'BAJA_CONGESTION_BAJAS_ALERTAS' END AS quadrant,
        CASE WHEN corridor_key = 'unresolved' THEN 'NO_PRIORIZAR_SIN_CORREDOR' WHEN integrated_corridor_pressure >= 75 AND corridor_event_congestion_coupling >= 45 THEN 'CRITICO_INTEGRADO'
        WHEN jam_pressure_norm >= 70 AND alert_pressure_norm < 35 THEN 'CONGESTION_NO_EXPLICADA_POR_ALERTS' WHEN alert_pressure_norm >= 70 AND jam_pressure_norm < 35 THEN 'EVENTOS_SIN_CONGESTION_PROPORCIONAL'
        WHEN integrated_corridor_pressure >= 55 THEN 'PRIORIDAD_MEDIA_ALTA' WHEN corridor_event_congestion_coupling >= 45 THEN 'ACOPLAMIENTO_RELEVANTE' ELSE 'OBSERVACION_COMPLEMENTARIA' END AS integration_priority FROM is5)"""

add("integrated_summary", "corridor_key corridor_name jam_count_total:2 alert_count_total:2 same_hour_overlap_count:2 jam_active_hours:2 alert_active_hours:2 "
    "integrated_pressure_total:4 integrated_pressure_max:4 temporal_alignment_avg:4 reliability_avg:4 same_hour_overlap_rate:4 jam_hours_with_alert_pm1h_rate:4 "
    "explanatory_alert_share:4 jam_pressure_norm:4 alert_pressure_norm:4 corridor_event_congestion_coupling:4 integrated_corridor_pressure:4 quadrant integration_priority",
    lambda x: x.integrated, SUMMARY, "integrated")

add("quadrants", "quadrant corredores presion_promedio:4",
    lambda x: x.integrated.groupBy("quadrant").agg(F.count(F.lit(1)).alias("corredores"), F.avg("integrated_corridor_pressure").alias("presion_promedio")),
    f"{SUMMARY}, qd AS (SELECT quadrant, count(*) AS corredores, avg(integrated_corridor_pressure) AS presion_promedio FROM integrated GROUP BY 1)", "qd")

add("top_integrated", "corridor_key integrated_corridor_pressure:4",
    lambda x: top_rows(x.integrated.filter(F.col("corridor_key") != "unresolved"), 50, F.desc("integrated_corridor_pressure"), "corridor_key"),
    SUMMARY, "(SELECT * FROM integrated WHERE corridor_key <> 'unresolved' ORDER BY integrated_corridor_pressure DESC, corridor_key LIMIT 50)")

add("strongest_coupling", "corridor_key corridor_event_congestion_coupling:4",
    lambda x: top_rows(x.integrated.filter("same_hour_overlap_count > 0"), 50, F.desc("corridor_event_congestion_coupling"), "corridor_key"),
    SUMMARY, "(SELECT * FROM integrated WHERE same_hour_overlap_count > 0 ORDER BY corridor_event_congestion_coupling DESC, corridor_key LIMIT 50)")

add("hourly_overlap", "event_hour jam_count alert_count jam_delay_total:4 alert_impact_total:4 same_hour_overlap_count jam_without_alert_hours alert_without_jam_hours "
    "integrated_pressure_total:4 same_hour_overlap_share:4", lambda x: integrate.hourly_summary(x.panel),
    f"""{PANEL}, ho AS (SELECT event_hour, CAST(sum(jam_count) AS BIGINT) AS jam_count, CAST(sum(alert_count) AS BIGINT) AS alert_count, sum(jam_delay_total) AS jam_delay_total, sum(alert_impact_total) AS alert_impact_total,
 count(*) FILTER (alert_jam_same_hour_flag) AS same_hour_overlap_count, count(*) FILTER (jam_without_alert_flag) AS jam_without_alert_hours, count(*) FILTER (alert_without_jam_flag) AS alert_without_jam_hours,
 sum(integrated_corridor_hour_pressure) AS integrated_pressure_total FROM panel GROUP BY 1),
ho2 AS (SELECT *, ROUND(CASE WHEN same_hour_overlap_count + jam_without_alert_hours + alert_without_jam_hours = 0 THEN 0e0 ELSE same_hour_overlap_count / CAST(same_hour_overlap_count + jam_without_alert_hours + alert_without_jam_hours AS DOUBLE) END, 4) AS same_hour_overlap_share FROM ho)""", "ho2")

_CORR = "count(*) AS n, CASE WHEN count(*) > 2 THEN COALESCE(ROUND(corr(x, y), 4), 0) ELSE 0 END AS pearson, CASE WHEN count(*) > 2 THEN COALESCE(ROUND(corr(rx, ry), 4), 0) ELSE 0 END AS spearman"


def _ranked(rel: str, by: str) -> str:
    part = f"PARTITION BY {by}"
    avg = lambda v: f"(rank() OVER ({part} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1)/2e0)"
    return f"(SELECT *, {avg('x')} AS rx, {avg('y')} AS ry FROM {rel})"


LAGS = f"""{PANEL},
sh AS ({' UNION ALL '.join(f"SELECT {lag} AS lag, jam_intensity_total AS y, COALESCE({'lag' if lag < 0 else 'lead'}(alert_impact_total, {abs(lag)}) OVER (PARTITION BY corridor_key ORDER BY event_hour), 0) AS x FROM panel WHERE corridor_key <> 'unresolved'" for lag in (-2, -1, 0, 1, 2))}),
lg AS (SELECT lag AS lag_hours_alert_vs_jam, CASE WHEN lag < 0 THEN 'alert_before_jam' WHEN lag = 0 THEN 'same_hour' ELSE 'alert_after_jam' END AS interpretation, {_CORR}
       FROM {_ranked('(SELECT * FROM sh WHERE x > 0 OR y > 0)', 'lag')} GROUP BY lag),
lg2 AS (SELECT lag_hours_alert_vs_jam, interpretation, n AS n_active_rows, pearson AS pearson_alert_impact_vs_jam_intensity, spearman AS spearman_alert_impact_vs_jam_intensity FROM lg)"""
add("lag_analysis", "lag_hours_alert_vs_jam interpretation n_active_rows pearson_alert_impact_vs_jam_intensity:4 spearman_alert_impact_vs_jam_intensity:4",
    lambda x: integrate.lag_analysis(x.panel), LAGS, "lg2")

_PAIRS = [("corridor_hour", "panel", a, b, "AND (jam_count > 0 OR alert_count > 0)") for a, b in (("alert_impact_total", "jam_intensity_total"), ("critical_alert_count", "jam_delay_total"), ("alert_count", "jam_count"))] + \
         [("corridor_day", "integrated", a, b, "") for a, b in (("alert_impact_total", "jam_intensity_total"), ("critical_alert_count_total", "jam_delay_total"), ("alert_count_total", "jam_count_total"))]
CORR = f"""{SUMMARY},
cp AS ({' UNION ALL '.join(f"SELECT '{lv}' AS analysis_level, '{a}' AS x_variable, '{b}' AS y_variable, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {rel} WHERE corridor_key <> 'unresolved' {extra}" for lv, rel, a, b, extra in _PAIRS)}),
co AS (SELECT analysis_level, x_variable, y_variable, {_CORR} FROM {_ranked('(SELECT * FROM cp WHERE x > 0 OR y > 0)', 'analysis_level, x_variable, y_variable')} GROUP BY 1, 2, 3),
co2 AS (SELECT * EXCLUDE (n), n AS n_rows FROM co)"""
add("correlations", "analysis_level x_variable y_variable n_rows pearson:4 spearman:4",
    lambda x: integrate.correlation_pairs(x.panel, x.integrated), CORR, "co2")


def _quality(x):
    return integrate.quality_metrics(x.jams, x.alerts, x.panel, x.integrated, integrate.lag_analysis(x.panel),
                                     integrate.correlation_pairs(x.panel, x.integrated))


add("integration_quality", "metric value:4", _quality, f"""{SUMMARY},
qm AS (SELECT 'jams_unique' AS metric, CAST(count(*) AS DOUBLE) AS value FROM jams UNION ALL SELECT 'alerts_unique', count(*) FROM alerts
 UNION ALL SELECT 'corridor_keys_total', count(*) FROM integrated
 UNION ALL SELECT 'common_corridors_alerts_jams', count(*) FROM integrated WHERE corridor_key <> 'unresolved' AND jam_count_total > 0 AND alert_count_total > 0
 UNION ALL SELECT 'only_jams_corridors', count(*) FROM integrated WHERE corridor_key <> 'unresolved' AND jam_count_total > 0 AND alert_count_total = 0
 UNION ALL SELECT 'only_alerts_corridors', count(*) FROM integrated WHERE corridor_key <> 'unresolved' AND jam_count_total = 0 AND alert_count_total > 0
 UNION ALL SELECT 'corridor_hour_rows', count(*) FROM panel UNION ALL SELECT 'active_corridor_hour_rows', count(*) FROM panel WHERE has_jam OR has_alert
 UNION ALL SELECT 'same_hour_overlap_rows', count(*) FROM panel WHERE alert_jam_same_hour_flag UNION ALL SELECT 'jam_without_alert_rows', count(*) FROM panel WHERE jam_without_alert_flag
 UNION ALL SELECT 'alert_without_jam_rows', count(*) FROM panel WHERE alert_without_jam_flag
 UNION ALL SELECT 'best_lag_pearson', (WITH {LAGS[LAGS.index('sh AS'):]} SELECT lag_hours_alert_vs_jam FROM lg2 ORDER BY pearson_alert_impact_vs_jam_intensity DESC, 1 LIMIT 1)
 UNION ALL SELECT 'corridor_hour_alert_impact_jam_intensity_pearson', (SELECT ROUND(corr(alert_impact_total, jam_intensity_total), 4) FROM panel WHERE corridor_key <> 'unresolved' AND (jam_count > 0 OR alert_count > 0) AND (alert_impact_total > 0 OR jam_intensity_total > 0)))""", "qm")
