"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import add
from checks.sql import ALIASES, CONFIDENCE, ROADS, distance, ladder, local, norm, one_of, q, refs, resolve, tcompact, title, ttext, utm16, wsum
from corridor_spark.fixtures import cte
from corridor_spark.lexicons import (
    ALERT_DISTANCE, ALERT_DISTANCE_FAR, ALERT_GROUPS, ALERT_SEVERITY, ALERT_SUBTYPE_LABELS, ALERT_TYPE_LABELS,
    CRITICAL_GROUPS, OPERATIONAL_GROUPS, SAFETY_GROUPS,
)
from corridor_spark.operators.tables import top_rows
from corridor_spark.functions.geo import to_utm16
from corridor_spark.plans import alerts as plan
from corridor_spark.sources.sinks import alert_layer


def _by_type(table, fallback: str, text: bool) -> str:
    cases = []
    for kind, fragments, value in table:
        extra = " AND (" + " OR ".join(f"contains(subtype, {q(f)})" for f in fragments) + ")" if fragments else ""
        cases.append(f"WHEN type = {q(kind)}{extra} THEN {q(value) if text else f'{value}e0'}")
    return f"CASE {' '.join(cases)} ELSE {fallback} END"


def _labels(col: str, table) -> str:
    return f"CASE {col} {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in table.items())} END"


NEAREST = f"""
pairs AS (SELECT a.uuid, r.way_id, r.name, r.ref, r.highway, r.road_key_norm, r.road_type_category, r.source_department,
                 {distance('a.lon', 'a.lat')} AS d
          FROM al0 a JOIN seg r ON has_valid_coordinate AND (ax <> bx OR ay <> by_)),
near AS (SELECT uuid, way_id AS nearest_way_id, name AS nearest_name, ref AS nearest_ref, highway AS nearest_highway,
                road_key_norm AS nearest_road_key_norm, road_type_category AS nearest_road_type_category,
                source_department AS nearest_source_department, ROUND(d, 3) AS nearest_osm_distance_m
         FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY floor(d*1e6+0.5), way_id) rn FROM pairs) WHERE rn = 1)"""

ALERT0 = f"""{ROADS}, {ALIASES}, {cte('alert')},
al0 AS (SELECT *, CAST(hour({local('ts')}) AS INT) AS event_hour, CAST({local('ts')} AS DATE) AS event_date_local,
               COALESCE(lat BETWEEN 13.0 AND 14.7 AND lon BETWEEN -90.4 AND -87.5, false) AS has_valid_coordinate,
               {tcompact('street')} AS street_c, array_to_string({refs(ttext('street'))}, ';') AS route_ref
        FROM alert),
{NEAREST.strip()}"""

GROUPS = f"""
al1 AS (SELECT a.*, near.* EXCLUDE (uuid), {_by_type(ALERT_GROUPS, "'OTRO'", True)} AS alert_group,
               {_by_type(ALERT_SEVERITY, '35e0', False)} AS severity_base,
               {_labels('type', ALERT_TYPE_LABELS)} AS alert_type_norm,
               COALESCE({_labels('subtype', ALERT_SUBTYPE_LABELS)}, {title(tcompact("CASE WHEN subtype <> '' THEN subtype ELSE type END"))}) AS alert_subtype_norm,
               {ladder('nearest_osm_distance_m', ALERT_DISTANCE, ALERT_DISTANCE_FAR, 'NO_COORDINATE_FOR_OSM')} AS osm_match_status
        FROM al0 a LEFT JOIN near USING (uuid)),
al2 AS (SELECT *, ROUND(LEAST(GREATEST(severity_base + {norm('CAST(cluster_report_count AS DOUBLE)', .99)} * 8, 0), 100), 3) AS severity_proxy,
               CASE osm_match_status WHEN 'SPATIAL_HIGH' THEN 1e0 WHEN 'SPATIAL_MEDIUM' THEN 0.75e0 WHEN 'SPATIAL_LOW_REVIEW' THEN 0.45e0
                    WHEN 'SPATIAL_FAR_REVIEW' THEN 0.15e0 ELSE 0e0 END AS osm_spatial_confidence_score,
               {tcompact('city')} <> '' AS has_city,
               CASE WHEN nearest_way_id IS NULL THEN '' WHEN nearest_ref <> '' AND nearest_name <> '' THEN nearest_ref || ' / ' || nearest_name
                    WHEN nearest_ref <> '' THEN nearest_ref WHEN nearest_name <> '' THEN nearest_name
                    WHEN starts_with(nearest_road_key_norm, 'osm_way') THEN '' ELSE {title(tcompact('nearest_road_key_norm'))} END AS spatial_street
        FROM al1)"""

ALERTS = f"""{ALERT0},{GROUPS},
{resolve("SELECT street, has_city FROM al2 UNION ALL SELECT spatial_street, has_city FROM al2")},
al3 AS (SELECT a.*, t.corridor_norm AS tn, t.corridor_match_method AS tm, t.corridor_match_confidence AS tc, t.corridor_match_status AS tst,
               t.corridor_resolution_detail AS td, t.corridor_local_name AS tl,
               s.corridor_norm AS sn, s.corridor_match_method AS sm, s.corridor_match_confidence AS sc, s.corridor_match_status AS sst,
               s.corridor_resolution_detail AS sd, s.corridor_local_name AS sl,
               osm_match_status IN ('SPATIAL_HIGH', 'SPATIAL_MEDIUM', 'SPATIAL_LOW_REVIEW') AND s.corridor_match_status = 'RESOLVED' AS by_road
        FROM al2 a LEFT JOIN resolved t ON t.street = a.street AND t.has_city = a.has_city
        LEFT JOIN resolved s ON s.street = a.spatial_street AND s.has_city = a.has_city),
al4 AS (SELECT *, by_road AND tst = 'RESOLVED' AND tc = 'HIGH' AND {tcompact('tn')} <> {tcompact('sn')} AS overruled FROM al3),
al5 AS (SELECT *, CASE WHEN overruled THEN 't' WHEN by_road THEN 's' WHEN tst = 'RESOLVED' THEN 't' WHEN sst = 'RESOLVED' THEN 's' ELSE 't' END AS pick FROM al4),
al6 AS (SELECT *, CASE pick WHEN 't' THEN tn ELSE sn END AS corridor_norm_alert, CASE pick WHEN 't' THEN tm ELSE sm END AS corridor_match_method,
               CASE pick WHEN 't' THEN tc ELSE sc END AS corridor_match_confidence, CASE pick WHEN 't' THEN tst ELSE sst END AS corridor_match_status,
               CASE WHEN overruled THEN 'TEXT_FUNCTIONAL_WITH_SPATIAL_SUPPORT' WHEN by_road THEN 'SPATIAL_OSM' WHEN tst = 'RESOLVED' THEN 'TEXT_FALLBACK' ELSE 'UNRESOLVED' END AS corridor_match_source,
               CASE WHEN overruled THEN osm_match_status || ':TEXT_HIGH_OSM_LOCAL_DIFFERENT' WHEN by_road THEN osm_match_status || ':' || sd
                    WHEN tst = 'RESOLVED' THEN td ELSE 'NO_SPATIAL_OR_TEXT_CORRIDOR' END AS corridor_resolution_detail,
               tn AS text_corridor_norm, sn AS spatial_corridor_norm
        FROM al5),
al7 AS (SELECT *, CASE WHEN corridor_norm_alert = '' THEN 'UNRESOLVED' ELSE corridor_norm_alert END AS corridor_norm_alert_group,
               {CONFIDENCE} AS corridor_match_confidence_score,
               {norm('CAST(cluster_report_count AS DOUBLE)', .99)} AS cl FROM al6),
al8 AS (SELECT *, ROUND(100 * {wsum((.35, 'LEAST(GREATEST(reliability, 0), 10)/10'), (.20, 'LEAST(GREATEST(reportrating, 0), 5)/5'), (.20, 'cl'),
                (.15, 'osm_spatial_confidence_score'), (.10, 'LEAST(GREATEST(confidence, 0), 5)/5'))}, 3) AS alert_reliability_proxy FROM al7),
alerts AS (SELECT *, ROUND(LEAST(GREATEST({wsum((.48, 'severity_proxy'), (.22, 'alert_reliability_proxy'), (3, 'cl'), (1, 'osm_spatial_confidence_score'))}, 0), 100), 3) AS alert_impact_score,
               {one_of('alert_group', CRITICAL_GROUPS)} AS is_critical_alert, {one_of('alert_group', SAFETY_GROUPS)} AS is_safety_alert,
               {one_of('alert_group', OPERATIONAL_GROUPS)} AS is_operational_alert
        FROM al8)"""

ALERT_PANEL = f"""{ALERTS},
alert_panel AS (
  SELECT corridor_norm_alert_group AS corridor_norm_alert, event_hour, count(*) AS alerts_count, CAST(sum(cluster_report_count) AS BIGINT) AS reports_count,
         sum(alert_impact_score) AS impact_total, avg(alert_impact_score) AS impact_avg, avg(severity_proxy) AS severity_avg,
         sum(severity_proxy) AS severity_total, avg(alert_reliability_proxy) AS reliability_avg,
         count(*) FILTER (alert_group = 'ACCIDENTE') AS accident_count, count(*) FILTER (alert_group = 'CIERRE_VIAL') AS closure_count,
         count(*) FILTER (type = 'HAZARD') AS hazard_count, count(*) FILTER (type = 'JAM') AS jam_alert_count,
         count(*) FILTER (is_critical_alert) AS critical_alert_count, count(*) FILTER (is_safety_alert) AS safety_alert_count,
         count(*) FILTER (is_operational_alert) AS operational_alert_count,
         count(*) FILTER (osm_match_status IN ('SPATIAL_HIGH', 'SPATIAL_MEDIUM')) AS high_spatial_count,
         count(*) FILTER (corridor_match_status = 'UNRESOLVED') AS unresolved_count,
         ROUND(count(*) FILTER (is_critical_alert) / count(*), 4) AS critical_alert_rate
  FROM alerts GROUP BY ALL)"""

ALERT_SUMMARY = f"""{ALERT_PANEL},
as0 AS (
  SELECT corridor_norm_alert, CAST(sum(alerts_count) AS BIGINT) AS alerts_count_total, CAST(sum(reports_count) AS BIGINT) AS reports_count_total,
         count(DISTINCT event_hour) AS active_alert_hours, sum(impact_total) AS corridor_alert_impact, avg(severity_avg) AS corridor_severity_avg,
         avg(reliability_avg) AS corridor_reliability_avg, CAST(sum(critical_alert_count) AS BIGINT) AS critical_alert_count_total,
         CAST(sum(safety_alert_count) AS BIGINT) AS safety_alert_count_total, CAST(sum(high_spatial_count) AS BIGINT) AS high_spatial_count_total,
         CAST(sum(accident_count) AS BIGINT) AS accident_count_total,
         arg_max(event_hour, (impact_total, -event_hour)) AS peak_alert_hour, max(impact_total) AS peak_hour_impact
  FROM alert_panel GROUP BY 1),
as1 AS (SELECT a.*, ROUND(active_alert_hours/24e0, 4) AS corridor_alert_recurrence, ROUND(critical_alert_count_total/CAST(alerts_count_total AS DOUBLE), 4) AS critical_alert_rate,
               ROUND(safety_alert_count_total/CAST(alerts_count_total AS DOUBLE), 4) AS safety_alert_rate, ROUND(high_spatial_count_total/CAST(alerts_count_total AS DOUBLE), 4) AS high_spatial_rate,
               d.n AS alert_group_diversity
        FROM as0 a JOIN (SELECT corridor_norm_alert_group AS c, count(DISTINCT alert_group) AS n FROM alerts GROUP BY 1) d ON d.c = a.corridor_norm_alert),
alert_summary AS (SELECT *, CASE WHEN corridor_norm_alert = 'UNRESOLVED' THEN 0e0 ELSE ROUND(100 * {wsum((.24, norm('CAST(alerts_count_total AS DOUBLE)')), (.24, norm('corridor_alert_impact')),
   (.16, norm('CAST(reports_count_total AS DOUBLE)')), (.14, norm('CAST(active_alert_hours AS DOUBLE)', 1.0)), (.12, norm('critical_alert_rate', 1.0)), (.10, norm('corridor_reliability_avg')))}, 4) END AS corridor_alert_pressure
   FROM as1)"""

add("nearest_road", "uuid nearest_way_id nearest_osm_distance_m:3 nearest_highway osm_match_status",
    lambda x: x.alerts, f"{ALERT0},{GROUPS}", "al2")

add("alert_groups", "uuid alert_group alert_type_norm alert_subtype_norm severity_base:2 severity_proxy:4",
    lambda x: x.alerts, f"{ALERT0},{GROUPS}", "al2")

add("resolve_alert",
    "uuid corridor_norm_alert corridor_match_source corridor_match_method corridor_match_confidence corridor_match_status "
    "corridor_resolution_detail text_corridor_norm spatial_corridor_norm corridor_norm_alert_group",
    lambda x: x.alerts, ALERTS, "alerts")

add("alert_metrics", "uuid event_hour alert_reliability_proxy:4 alert_impact_score:4 is_critical_alert is_safety_alert is_operational_alert "
    "corridor_match_confidence_score:4 osm_spatial_confidence_score:4", lambda x: x.alerts, ALERTS, "alerts")

add("alert_panel",
    "corridor_norm_alert event_hour alerts_count reports_count impact_total:4 impact_avg:4 severity_avg:4 severity_total:4 "
    "reliability_avg:4 accident_count closure_count hazard_count jam_alert_count critical_alert_count safety_alert_count "
    "operational_alert_count high_spatial_count unresolved_count critical_alert_rate:4", lambda x: x.alert_panel, ALERT_PANEL, "alert_panel")

add("alert_summary",
    "corridor_norm_alert alerts_count_total reports_count_total active_alert_hours corridor_alert_impact:4 corridor_severity_avg:4 "
    "corridor_reliability_avg:4 critical_alert_count_total safety_alert_count_total high_spatial_count_total accident_count_total "
    "peak_alert_hour peak_hour_impact:4 corridor_alert_recurrence:4 critical_alert_rate:4 safety_alert_rate:4 high_spatial_rate:4 "
    "alert_group_diversity corridor_alert_pressure:4", lambda x: x.alert_summary, ALERT_SUMMARY, "alert_summary")

add("type_ranking", "alert_group alert_type_norm alert_subtype_norm alerts reports impact_total:4 severity_avg:4 reliability_avg:4",
    lambda x: plan.type_ranking(x.alerts), f"""{ALERTS}, tr AS (SELECT alert_group, alert_type_norm, alert_subtype_norm, count(*) AS alerts,
 CAST(sum(cluster_report_count) AS BIGINT) AS reports, sum(alert_impact_score) AS impact_total, avg(severity_proxy) AS severity_avg,
 avg(alert_reliability_proxy) AS reliability_avg FROM alerts GROUP BY ALL)""", "tr")

add("alert_city_distribution", "city alerts reports avg_reliability:6 avg_report_rating:6",
    lambda x: plan.distribution(x.prepared_alerts, "city"), f"""{cte('alert')}, d AS (SELECT city, count(*) AS alerts, CAST(sum(cluster_report_count) AS BIGINT) AS reports,
 avg(reliability) AS avg_reliability, avg(reportrating) AS avg_report_rating FROM alert GROUP BY city)""", "d")

add("top_alerts", "uuid alert_group alert_impact_score:4", lambda x: top_rows(x.alerts, 75, F.desc("alert_impact_score"), "uuid"),
    ALERTS, "(SELECT * FROM alerts ORDER BY alert_impact_score DESC, uuid LIMIT 75)")


def _grid(x):
    a = x.alerts.withColumn("_p", to_utm16(F.col("lon"), F.col("lat"))).withColumns({"x_utm": F.col("_p.x"), "y_utm": F.col("_p.y")})
    return plan.add_density(a, plan.grid_density(a))


_X, _Y = utm16("lon", "lat")
add("alert_grid", "uuid grid_x grid_y grid_alert_count grid_report_count alert_density:4 impact_density:4", _grid, f"""{ALERTS},
ga AS (SELECT *, CAST(floor({_X}/1000) AS BIGINT) AS grid_x, CAST(floor({_Y}/1000) AS BIGINT) AS grid_y FROM alerts),
g0 AS (SELECT grid_x, grid_y, count(DISTINCT uuid) AS n, CAST(sum(cluster_report_count) AS BIGINT) AS r, sum(alert_impact_score) AS i FROM ga WHERE grid_x IS NOT NULL AND grid_y IS NOT NULL GROUP BY 1, 2),
g1 AS (SELECT *, ROUND(100*{norm('CAST(n AS DOUBLE)', .99)}, 3) AS alert_density, ROUND(100*{norm('i', .99)}, 3) AS impact_density FROM g0),
g2 AS (SELECT uuid, ga.grid_x, ga.grid_y, n AS grid_alert_count, r AS grid_report_count, alert_density, impact_density FROM ga LEFT JOIN g1 ON g1.grid_x = ga.grid_x AND g1.grid_y = ga.grid_y)""", "g2")

add("alert_layers", "corridor_norm_alert corridor_norm_key alerts_count_total corridor_alert_pressure:4 high_spatial_rate:4",
    lambda x: alert_layer(x.alert_summary), f"{ALERT_SUMMARY}, l AS (SELECT *, {tcompact('corridor_norm_alert')} AS corridor_norm_key FROM alert_summary WHERE corridor_norm_alert <> 'UNRESOLVED')", "l")
