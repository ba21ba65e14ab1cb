"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.alerts import ALERTS
from checks.incidents import EVENTS
from checks.registry import add
from checks.sql import JAMS, distance, is_ref, ladder, local, q, tcompact
from corridor_spark.fixtures import cte
from corridor_spark.lexicons import NAMED_DISTANCE, NAMED_DISTANCE_FAR, NO_TEXT_CLUE, ROAD_TERM_PATTERN, TEXT_CLUES
from corridor_spark.plans import quality as plan
from corridor_spark.plans.jams import add_time
from corridor_spark.sources import roads

_FIELDS = ("uuid", "id", "level", "delay", "street", "city")
add("field_profile", "field non_null null_count null_pct:4 blank_or_null_count blank_or_null_pct:4 unique_count",
    lambda x: plan.field_profile(x.view("jam_obs").select(*_FIELDS)),
    f"{cte('jam_obs')}, f AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS non_null, count(*) - count({c}) AS null_count, ROUND((count(*) - count({c}))/CAST(count(*) AS DOUBLE)*100, 2) AS null_pct, "
        f"count(*) FILTER (trim(COALESCE(CAST({c} AS VARCHAR), '')) = '') AS blank_or_null_count, "
        f"ROUND(count(*) FILTER (trim(COALESCE(CAST({c} AS VARCHAR), '')) = '')/CAST(count(*) AS DOUBLE)*100, 2) AS blank_or_null_pct, count(DISTINCT {c}) AS unique_count FROM jam_obs"
        for c in _FIELDS) + ")", "f")

add("hourly_distribution", "event_hour raw_records unique_jams avg_level:6 delay_sum:4 length_sum:4 avg_speed_kmh:6",
    lambda x: plan.hourly_distribution(add_time(x.view("jam_obs"))),
    f"{cte('jam_obs')}, h AS (SELECT CAST(hour({local('ts')}) AS INT) AS event_hour, count(*) AS raw_records, count(DISTINCT uuid) AS unique_jams, avg(level) AS avg_level, "
    "sum(delay) AS delay_sum, sum(length) AS length_sum, avg(speedkmh) AS avg_speed_kmh FROM jam_obs GROUP BY 1)", "h")

add("distribution", "variable count min:4 p25:4 p50:4 p75:4 p90:4 p95:4 p99:4 max:4 mean:6 std:6",
    lambda x: plan.distribution(x.view("jam_obs"), ["level", "delay", "length", "speedkmh"]),
    f"{cte('jam_obs')}, d AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, count({c}) AS count, min({c}) AS min, " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {v}) AS {n}" for n, v in plan.QUANTILES.items())
        + f", max({c}) AS max, avg({c}) AS mean, stddev_pop({c}) AS std FROM jam_obs" for c in ("level", "delay", "length", "speedkmh")) + ")", "d")

_m = lambda rel, pairs: " UNION ALL ".join(f"SELECT {q(n)} AS metric, CAST({e} AS DOUBLE) AS value FROM {rel}" for n, e in pairs)
_pct = lambda c: f"ROUND(count(*) FILTER ({c})/CAST(count(*) AS DOUBLE)*100, 2)"
_n = lambda c: f"count(*) FILTER ({c})"

add("duplicates", "metric value:4", lambda x: plan.duplicate_counts(x.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey"),
    "dd AS (" + _m("lineitem", [("raw_rows", "count(*)"), ("exact_duplicate_rows", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem))"),
                                ("uuid_duplicate_rows", "count(*) - count(DISTINCT l_orderkey)")]) + ")", "dd")

add("jam_quality", "metric value:4", lambda x: plan.jam_quality(x.view("jam_obs"), x.jams), f"{JAMS}, jq AS (" + _m("jam_obs", [
    ("raw_rows", "count(*)"), ("exact_duplicate_rows", "0"), ("uuid_duplicate_rows", "count(*) - count(DISTINCT uuid)")]) .replace("CAST(0 AS DOUBLE) AS value FROM jam_obs", "0e0 AS value") + " UNION ALL " + _m("jams", [
    ("unique_jams_uuid", "count(*)"), ("street_empty_count", _n("street_modal = ''")), ("street_empty_pct", _pct("street_modal = ''")),
    ("corridor_assigned_count", _n("corridor_match_status = 'RESOLVED'")), ("corridor_assigned_pct", _pct("corridor_match_status = 'RESOLVED'")),
    ("high_confidence_count", _n("corridor_match_confidence = 'HIGH'")), ("medium_confidence_count", _n("corridor_match_confidence = 'MEDIUM'")),
    ("low_confidence_count", _n("corridor_match_confidence = 'LOW'")), ("unresolved_count", _n("corridor_match_status = 'UNRESOLVED'")),
    ("negative_delay_count", _n("delay_max < 0")), ("zero_speed_count", _n("speed_min = 0")), ("country_not_es_count", "count(*)"),
    ("low_stability_count", _n("jam_estimation_stability_class = 'LOW'"))]) + ")", "jq")

_st = lambda v: _n(f"osm_match_status = '{v}'")
add("quality_metrics", "metric value:4", lambda x: plan.alert_quality(x.view("alert"), x.alerts), f"{ALERTS}, aq AS (SELECT 'exact_duplicate_rows' AS metric, 0e0 AS value UNION ALL " + _m("alert", [
    ("raw_rows", "count(*)"), ("uuid_duplicate_rows", "count(*) - count(DISTINCT uuid)")]) + " UNION ALL " + _m("alerts", [
    ("unique_alerts_uuid", "count(DISTINCT uuid)"), ("cluster_id_unique", "0*count(*)"), ("cluster_report_count_total", "sum(cluster_report_count)"),
    ("street_empty_count", _n("street_c = ''")), ("street_empty_pct", _pct("street_c = ''")), ("city_null_count", _n("city IS NULL")), ("city_null_pct", _pct("city IS NULL")),
    ("valid_coordinate_count", _n("has_valid_coordinate")), ("valid_coordinate_pct", _pct("has_valid_coordinate")),
    ("spatial_high_count", _st("SPATIAL_HIGH")), ("spatial_medium_count", _st("SPATIAL_MEDIUM")), ("spatial_low_review_count", _st("SPATIAL_LOW_REVIEW")),
    ("spatial_far_review_count", _st("SPATIAL_FAR_REVIEW")), ("corridor_assigned_count", _n("corridor_match_status = 'RESOLVED'")), ("corridor_assigned_pct", _pct("corridor_match_status = 'RESOLVED'")),
    ("unresolved_count", _n("corridor_match_status = 'UNRESOLVED'")), ("critical_alert_count", _n("is_critical_alert")), ("safety_alert_count", _n("is_safety_alert"))]) + ")", "aq")

add("extreme_jams", "uuid corridor_norm delay_max:4 length_max:4 speed_min:4 jam_intensity_score:4", lambda x: plan.extreme_jams(x.jams), JAMS,
    "(SELECT * FROM jams WHERE delay_max >= (SELECT quantile_cont(delay_max, .99) FROM jams) OR length_max >= (SELECT quantile_cont(length_max, .99) FROM jams) "
    "OR jam_intensity_score >= (SELECT quantile_cont(jam_intensity_score, .99) FROM jams) OR delay_max < 0 OR speed_min = 0 OR jam_estimation_stability_class = 'LOW')")
add("extreme_cases", "uuid alert_group alert_impact_score:4 osm_match_status", lambda x: plan.extreme_alerts(x.alerts), ALERTS,
    "(SELECT * FROM alerts WHERE alert_impact_score >= (SELECT quantile_cont(alert_impact_score, .99) FROM alerts) OR cluster_report_count >= (SELECT quantile_cont(cluster_report_count, .99) FROM alerts) "
    "OR is_critical_alert OR osm_match_status IN ('SPATIAL_LOW_REVIEW', 'SPATIAL_FAR_REVIEW'))")
add("unresolved_jams", "uuid street_modal jam_intensity_score:4 unresolved_reason", lambda x: plan.unresolved(x.jams), JAMS,
    "(SELECT *, corridor_resolution_detail AS unresolved_reason FROM jams WHERE corridor_match_status = 'UNRESOLVED')")

_amb = lambda k: f"{k} IN (SELECT {k} FROM jq0 WHERE {k} <> '' GROUP BY {k} HAVING count(DISTINCT corridor_norm_group) > 1)"
_R = "corridor_norm_group <> 'UNRESOLVED'"
CONFLICTS = f"""{JAMS}, jq0 AS (SELECT *, {tcompact('corridor_norm_group')} AS nm, array_to_string(refs, ';') AS route_ref, street_modal AS street_norm,
  jam_intensity_score >= quantile_cont(jam_intensity_score, .9) OVER () AS hi FROM jams),
jc AS ({' UNION ALL '.join(f"SELECT uuid, corridor_norm_group, jam_intensity_score, {q(t)} AS issue_type FROM jq0 WHERE {c}" for t, c in (
    ('UNRESOLVED', "corridor_norm_group = 'UNRESOLVED'"), ('UNRESOLVED_HIGH_IMPACT', "corridor_norm_group = 'UNRESOLVED' AND hi"),
    ('TEXT_STREET_NOT_IN_OSM', f"{_R} AND corridor_match_method = 'TEXT_STREET'"), ('NODE_CONTEXT_USED_AS_CORRIDOR', f"{_R} AND corridor_match_method = 'NODE_CONTEXT'"),
    ('LOW_CONFIDENCE_HIGH_IMPACT', f"{_R} AND corridor_match_confidence = 'LOW' AND hi"), ('REFERENCE_WITHOUT_FUNCTIONAL_NAME', f"{_R} AND {is_ref('nm')}"),
    ('SAME_STREET_MULTIPLE_CORRIDORS', f"{_R} AND {_amb('street_norm')}"), ('SAME_REF_MULTIPLE_CORRIDORS', f"{_R} AND {_amb('route_ref')}")))})"""
add("jam_conflicts", "uuid corridor_norm_group jam_intensity_score:4 issue_type", lambda x: plan.jam_conflicts(x.jams), CONFLICTS, "jc")

ACONF = f"""{ALERTS}, a0 AS (SELECT *, {tcompact('text_corridor_norm')} AS tk, {tcompact('spatial_corridor_norm')} AS sk, alert_impact_score >= quantile_cont(alert_impact_score, .9) OVER () AS hi FROM alerts),
ac AS ({' UNION ALL '.join(f"SELECT uuid, alert_group, alert_impact_score, {q(t)} AS issue_type FROM a0 WHERE {c}" for t, c in (
    ('UNRESOLVED', "corridor_norm_alert_group = 'UNRESOLVED'"), ('UNRESOLVED_HIGH_IMPACT', "corridor_norm_alert_group = 'UNRESOLVED' AND hi"),
    ('LOW_SPATIAL_CONFIDENCE', "osm_match_status IN ('SPATIAL_LOW_REVIEW', 'SPATIAL_FAR_REVIEW')"), ('TEXT_OSM_CORRIDOR_MISMATCH', "tk <> '' AND sk <> '' AND tk <> sk"),
    ('MISSING_CITY', "city IS NULL"), ('MISSING_STREET', "street_c = ''"), ('LOW_CONFIDENCE_HIGH_IMPACT', "corridor_match_confidence = 'LOW' AND hi")))})"""
add("conflicts", "uuid alert_group alert_impact_score:4 issue_type", lambda x: plan.alert_conflicts(x.alerts), ACONF, "ac")

_rd = "(COALESCE(nearest_osm_name, '') <> '' OR COALESCE(nearest_osm_ref, '') <> '')"
_re = ROAD_TERM_PATTERN
CAUSES = f"""{EVENTS}, u0 AS (SELECT *, regexp_matches(concat_ws(' ', address, observation, corridor_candidate, text_corridor_norm, COALESCE(nearest_osm_name, ''), COALESCE(nearest_osm_ref, '')), {q(_re)}) AS road_term_present,
 CASE WHEN NOT coordinate_pair_present AND corridor_norm = '' THEN 'A_SIN_COORDENADA_SIN_CORREDOR_TEXTUAL' WHEN NOT coordinate_pair_present THEN 'B_SIN_COORDENADA_CON_CORREDOR_TEXTUAL'
  WHEN coordinate_quality_status = 'OUTSIDE_EL_SALVADOR_BBOX' THEN 'C_COORDENADA_FUERA_SV' WHEN osm_match_status = 'NO_NEAR_OSM_SEGMENT' THEN 'D_COORDENADA_SIN_SEGMENTO_OSM_CERCANO'
  WHEN coordinate_inside_sv_bbox AND NOT {_rd} AND corridor_norm <> '' THEN 'E_CORREDOR_TEXTUAL_PERO_OSM_SIN_NOMBRE_REF' WHEN coordinate_inside_sv_bbox AND NOT {_rd} THEN 'F_COORDENADA_VALIDA_PERO_OSM_SIN_NOMBRE_REF_Y_SIN_TEXTO_VIAL'
  WHEN osm_match_status = 'SPATIAL_OSM_DISTANCE_CONFLICT' THEN 'G_DISTANCIA_OSM_CONFLICTIVA' WHEN coordinate_inside_sv_bbox AND {_rd} AND corridor_norm = '' THEN 'H_OSM_CON_REF_NO_NORMALIZADA_O_SIN_REGLA' ELSE 'Z_OTRO' END AS unresolved_cause
 FROM events_ WHERE text_osm_resolution = 'UNRESOLVED'),
u1 AS (SELECT *, CASE unresolved_cause WHEN 'A_SIN_COORDENADA_SIN_CORREDOR_TEXTUAL' THEN CASE WHEN road_term_present THEN 'REVISAR_TEXTO_O_GEOCODIFICAR' ELSE 'NO_USAR_PARA_CORREDOR_HASTA_TENER_UBICACION' END
 {' '.join(f"WHEN {q(c)} THEN {q(a)}" for c, a in plan.ACTIONS.items())} ELSE 'REVISION' END AS recommended_action FROM u0),
u2 AS (SELECT unresolved_cause, recommended_action, count(*) AS events, CAST(sum(mentions) AS BIGINT) AS mentions, sum(impact_social_score) AS impact_social, count(*) FILTER (fatality_flag) AS fatality_events,
 count(*) FILTER (injury_flag) AS injury_events, count(*) FILTER (road_term_present) AS road_text_events FROM u1 GROUP BY 1, 2)"""
add("unresolved_causes", "unresolved_cause recommended_action events mentions impact_social:4 fatality_events injury_events road_text_events",
    lambda x: plan.unresolved_causes(x.events), CAUSES, "u2")

add("review_points", "uuid coordinate_quality_status osm_match_status text_osm_resolution impact_social_score:4",
    lambda x: plan.review_points(x.events.withColumn("uuid", F.col("uuid").cast("bigint"))), EVENTS,
    "(SELECT * FROM events_ WHERE text_osm_resolution = 'UNRESOLVED' OR osm_match_status IN ('SPATIAL_OSM_LOW_REVIEW', 'SPATIAL_OSM_DISTANCE_CONFLICT', 'NO_COORDINATE_FOR_OSM', 'NO_NEAR_OSM_SEGMENT') "
    "OR coordinate_quality_status IN ('MISSING_POINT', 'OUTSIDE_EL_SALVADOR_BBOX', 'LOW_GEO_CONFIDENCE_POINT') ORDER BY impact_social_score DESC, uuid LIMIT 40)")


def _named_pieces(x):
    return roads.pieces(roads.named_segments(x.segments), ["name", "ref", "highway"], points=True)


def _k_named(x):
    points = x.prepared_alerts.filter("has_valid_coordinate").select(F.col("uuid").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return plan.named_candidates(points, _named_pieces(x), ["way_id", "name", "highway"])


_KY = "110574e0"
add("k_nearest_named", "point_id candidate_rank way_id name highway distance_m:4", _k_named, f"""{cte('road_piece', 'alert')},
kp AS (SELECT a.uuid AS point_id, r.way_id, r.name, r.highway, ROUND({distance('a.lon', 'a.lat', None, _KY)}, 2) AS distance_m, {distance('a.lon', 'a.lat', None, _KY)} AS raw
 FROM alert a JOIN road_piece r ON a.lat BETWEEN 13.0 AND 14.7 AND a.lon BETWEEN -90.4 AND -87.5 AND (r.name <> '' OR r.ref <> '')),
kn AS (SELECT *, CAST(row_number() OVER (PARTITION BY point_id ORDER BY distance_m, way_id) AS INT) AS candidate_rank FROM kp WHERE raw <= 750),
k5 AS (SELECT * FROM kn WHERE candidate_rank <= 5)""", "k5")


def _recovery(x):
    cases = plan.unnamed_cases(x.events.withColumn("text_osm_resolution", F.lit("UNRESOLVED")).withColumn("corridor_norm", F.lit("")))
    points = cases.select(F.col("uuid").alias("point_id"), F.col("longitude_num").alias("x"), F.col("latitude_num").alias("y"))
    return plan.named_recovery(cases, plan.named_candidates(points, _named_pieces(x), ["way_id"]))


_clue = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(concat_ws(' ', address, observation), {q(p)}) THEN {q(n)} END" for n, p in TEXT_CLUES) + "], lambda x: x IS NOT NULL), ';')"
add("named_recovery", "uuid candidate_distance_m:4 candidate_osm_way_id nearest_named_status text_clues", _recovery, f"""{EVENTS},
uc AS (SELECT * FROM events_ WHERE coordinate_quality_status IN ('VALID_POINT', 'VALID_POINT_REPEATED_COORDINATE') AND COALESCE(nearest_osm_name, '') = '' AND COALESCE(nearest_osm_ref, '') = ''),
up AS (SELECT u.uuid, r.way_id, {distance('u.lon', 'u.lat', None, _KY)} AS raw FROM uc u JOIN road_piece r ON r.name <> '' OR r.ref <> ''),
ub AS (SELECT uuid, way_id, ROUND(raw, 2) AS dm FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY ROUND(raw, 2), way_id) rn FROM up WHERE raw <= 750) WHERE rn = 1),
ur AS (SELECT CAST(u.uuid AS VARCHAR) AS uuid, dm AS candidate_distance_m, way_id AS candidate_osm_way_id, {ladder('dm', NAMED_DISTANCE, NAMED_DISTANCE_FAR, NAMED_DISTANCE_FAR)} AS nearest_named_status,
 CASE WHEN {_clue} = '' THEN {q(NO_TEXT_CLUE)} ELSE {_clue} END AS text_clues FROM uc u LEFT JOIN ub USING (uuid))""", "ur")
