"""Evaluation queries: first index, capital area, source fitness."""

from __future__ import annotations

from checks.incidents import BASE
from checks.registry import add
from checks.sql import fold, has, one_of, q, sub
from corridor_spark.lexicons import (
    CAPITAL_CORE, CAPITAL_CORRIDORS, CAPITAL_EXTENDED, CAPITAL_HINTS, CAPITAL_KM, CAPITAL_PHRASE_STOPS, CAPITAL_ROAD_WORDS,
    CAPITAL_SUBAREAS, CROSSING_PATTERNS, EARLY_SEVERITY_TERMS, MATURITY, MENTIONED_DEPARTMENTS, MULTI_EVENT_TERMS, NODE_TERMS, NOT_READY,
    READINESS, ROAD_TYPE_TERMS, SEVERITY_BONUS,
)
from corridor_spark.operators.tables import share_table
from corridor_spark.plans import evaluate as plan


def _norm(x: str) -> str:
    return f"trim({sub(sub(fold(x), '<[^>]+>', ' '), r'[\s\p{Z}\x1c-\x1f\x85]+', ' ')})"


EARLY = f"""{BASE},
en AS (SELECT b.* EXCLUDE ({', '.join(EARLY_SEVERITY_TERMS)}, severity_class, severity_score, injury_count_text, fatality_count_text, obs),
   {_norm('observation')} AS obs, {_norm('incident')} AS inc2, {_norm('department')} AS dep2, {_norm('municipality')} AS mun2, injury_count_text AS ic, fatality_count_text AS fc FROM base b),
ef AS (SELECT *, {', '.join(f'{has("obs", t)} AS {n}' for n, t in EARLY_SEVERITY_TERMS.items())}, {has('obs', MULTI_EVENT_TERMS)} AS aggregate_news_flag,
   list_filter([{', '.join(q(d) for d in MENTIONED_DEPARTMENTS)}], lambda d: contains(obs, d)) AS named FROM en),
eg AS (SELECT *, len(named) > 0 AND dep2 <> '' AND NOT list_contains(named, dep2) AS location_conflict_flag,
   CASE WHEN material_damage_only_flag THEN 'MATERIAL_DAMAGE_ONLY' WHEN fatality_flag THEN 'FATALITY_REPORTED' WHEN injury_flag THEN 'INJURY_REPORTED' WHEN inc2 = 'traffic_accident' THEN 'TRAFFIC_ACCIDENT_UNSPECIFIED'
     WHEN obstruction_flag THEN 'ROAD_AFFECTATION' ELSE 'OTHER_LOW_INFORMATION' END AS severity_class,
   CASE WHEN fatality_flag THEN 0.9e0 + LEAST(fc, 3)*0.03e0 WHEN injury_flag THEN 0.5e0 + LEAST(ic, 6)*0.05e0 WHEN inc2 = 'traffic_accident' THEN 0.32e0 WHEN obstruction_flag THEN 0.22e0 ELSE 0.12e0 END
     {' '.join(f'+ CASE WHEN {f} THEN {b}e0 ELSE 0e0 END' for f, b in SEVERITY_BONUS)} AS sev0,
   CASE WHEN aggregate_news_flag THEN 'MULTI_LOCATION_NEWS' WHEN coordinate_pair_present THEN 'POINT' WHEN trim(address) <> '' AND trim(municipality) <> '' THEN 'ADDRESS_TEXT' WHEN trim(municipality) <> '' THEN 'MUNICIPALITY'
     WHEN trim(department) <> '' THEN 'DEPARTMENT' WHEN trim(address) <> '' THEN 'TEXT_ONLY' ELSE 'UNKNOWN' END AS spatial_level FROM ef),
eh AS (SELECT *, ROUND(LEAST(GREATEST(CASE WHEN material_damage_only_flag THEN LEAST(sev0, 0.25) ELSE sev0 END, 0), 1), 4) AS severity_score, LEAST(ln(1+mentions)/ln(11e0), 1) AS ev_, LEAST(geo_confidence + CASE WHEN coordinate_pair_present THEN 0.1 ELSE 0 END, 1) AS sp_,
   CASE WHEN trim(address) <> '' THEN 0.2e0 ELSE 0 END + CASE WHEN trim(municipality) <> '' THEN 0.15e0 ELSE 0 END + CASE WHEN trim(department) <> '' THEN 0.15e0 ELSE 0 END + LEAST(source_diversity, 3)/3e0*0.15e0 + 2/3e0*0.1e0
     + CASE WHEN coordinate_pair_present THEN 0.15e0 ELSE 0 END + CASE WHEN NOT aggregate_news_flag THEN 0.1e0 ELSE 0 END AS q0 FROM eg),
ei AS (SELECT *, LEAST(CASE WHEN location_conflict_flag THEN GREATEST(q0 - 0.15e0, 0) ELSE q0 END, 1) AS q1 FROM eh),
early AS (SELECT *, ROUND(ev_, 4) AS evidence_score, ROUND(sp_, 4) AS spatial_score, ROUND(q1, 4) AS data_quality_score, ROUND(100*(0.35e0*severity_score + 0.25e0*ev_ + 0.2e0*sp_ + 0.2e0*q1), 2) AS social_road_event_index_0_100,
   ROUND(LEAST(GREATEST(100*(0.3e0*ROUND(q1, 4) + 0.25e0*CASE WHEN spatial_level = 'POINT' AND NOT location_conflict_flag THEN 1 WHEN spatial_level = 'ADDRESS_TEXT' THEN 0.75 WHEN spatial_level IN ('MUNICIPALITY', 'DEPARTMENT') THEN 0.45
     WHEN spatial_level = 'MULTI_LOCATION_NEWS' THEN 0.2 WHEN spatial_level = 'TEXT_ONLY' THEN 0.25 ELSE 0.1 END + 0.2e0*geo_confidence + 0.15e0*ROUND(ev_, 4) + 0.1e0*CASE WHEN aggregate_news_flag OR location_conflict_flag THEN 0 ELSE 1 END)
     - 100*(CASE WHEN aggregate_news_flag THEN 0.2 ELSE 0 END + CASE WHEN location_conflict_flag THEN 0.25 ELSE 0 END), 0), 100), 2) AS metric_readiness_score_0_100 FROM ei)"""
STR = "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM {})".format
add("early_index", "uuid severity_class severity_score:4 evidence_score:4 spatial_score:4 data_quality_score:4 social_road_event_index_0_100:4 spatial_level aggregate_news_flag location_conflict_flag metric_readiness_score_0_100:4",
    lambda x: x.early, EARLY, STR("early"))
_M = ("count(*) AS events, count(*) FILTER (incident = 'TRAFFIC_ACCIDENT') AS traffic_accidents, sum(social_road_event_index_0_100) AS score_sum, avg(social_road_event_index_0_100) AS avg_event_index, "
      "sum(severity_score) AS severity_sum, CAST(sum(mentions) AS BIGINT) AS mentions_sum, count(*) FILTER (spatial_level = 'POINT') AS point_events")
add("daily_cumulative", "event_date events traffic_accidents score_sum:4 avg_event_index:4 severity_sum:4 mentions_sum point_events cumulative_events cumulative_score:4 daily_social_road_index_0_100:4 cumulative_social_signal_0_100:4",
    lambda x: plan.daily_index(x.early), f"""{EARLY}, d0 AS (SELECT event_date, {_M} FROM early GROUP BY 1),
d1 AS (SELECT *, CAST(sum(events) OVER (ORDER BY event_date) AS BIGINT) AS cumulative_events, ROUND(sum(score_sum) OVER (ORDER BY event_date), 2) AS cumulative_score, ROUND(score_sum/max(score_sum) OVER ()*100, 2) AS daily_social_road_index_0_100 FROM d0),
d2 AS (SELECT *, ROUND(cumulative_score/max(cumulative_score) OVER ()*100, 2) AS cumulative_social_signal_0_100 FROM d1)""", "d2")
add("territory_index", "department_norm events score_sum:4 avg_event_index:4 index_0_100:4", lambda x: plan.territory_index(x.early, "department_norm"),
    f"{EARLY}, d0 AS (SELECT department_norm, {_M} FROM early GROUP BY 1), d1 AS (SELECT *, ROUND(score_sum/max(score_sum) OVER ()*100, 2) AS index_0_100 FROM d0)", "d1")
_READY = f"""{EARLY}, rd0 AS (SELECT *, CASE WHEN spatial_level = 'POINT' AND (aggregate_news_flag OR location_conflict_flag) THEN 'UNKNOWN' ELSE spatial_level END AS lv FROM early),
rd1 AS (SELECT *, CASE {' '.join(f"WHEN lv = {q(level)} THEN {q(row[0])}" for level, row in READINESS.items())} ELSE {q(NOT_READY[0])} END AS ready FROM rd0),
mn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM (SELECT DISTINCT incident, mention FROM ev))"""
_PART = "ROUND(100*{0}/CAST((SELECT count(*) FROM rd1) AS DOUBLE), 2)".format
_QUALITY = [
    ("eventos_totales", "true"), ("eventos_traffic_accident", "incident = 'TRAFFIC_ACCIDENT'"), ("eventos_other", "incident = 'OTHER'"),
    ("eventos_con_multiples_menciones", "mentions > 1"), ("eventos_con_mas_de_una_fuente", "source_diversity > 1"), ("eventos_con_lesionados_texto", "injury_flag"),
    ("eventos_con_fallecidos_texto", "fatality_flag"), ("eventos_con_usuarios_vulnerables", "vulnerable_user_flag"), ("eventos_motocicleta", "motorcycle_flag"),
    ("eventos_peaton_atropello", "pedestrian_flag"), ("eventos_vehiculo_pesado_o_tp", "heavy_vehicle_flag"), ("eventos_con_afectacion_vial", "obstruction_flag"),
    ("registros_con_lat_lon", "latitude_num IS NOT NULL"), ("eventos_puntuales_validables", "spatial_level = 'POINT'"), ("eventos_direccion_municipio", "spatial_level = 'ADDRESS_TEXT'"),
    ("eventos_solo_texto", "spatial_level = 'TEXT_ONLY'"), ("eventos_multiubicacion", "aggregate_news_flag"), ("eventos_con_conflicto_ubicacion", "location_conflict_flag"),
    ("eventos_usables_ahora_espacialmente", "ready = 'USABLE_PARA_METRICA_ESPACIAL'"), ("eventos_usables_con_geocodificacion", "ready = 'USABLE_CON_GEOCODIFICACION'"),
    ("eventos_usables_territoriales", "ready = 'USABLE_PARA_METRICA_TERRITORIAL'")]
add("early_quality", "metric value:4 percent:4", lambda x: plan.early_quality(x.early, x.mentions.count()), f"{_READY}, s AS (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS metric, CAST(count(*) FILTER ({c}) AS DOUBLE) AS value, {_PART(f'count(*) FILTER ({c})')} AS percent FROM rd1" for n, c in _QUALITY]
    + ["SELECT 'menciones_expandidas', n, NULL FROM mn", "SELECT 'promedio_menciones_por_evento', ROUND(avg(mentions), 2), NULL FROM rd1"]) + ")", "s")
_USABLE = {"datetime": "trim(datetime) <> ''", "incident": "trim(incident) <> ''", "observation": "trim(observation) <> ''", "mentions": "mentions IS NOT NULL", "source_diversity": "source_diversity IS NOT NULL",
           "severity_score": "severity_score IS NOT NULL", "injury_flag": "injury_flag", "fatality_flag": "fatality_flag", "vulnerable_user_flag": "vulnerable_user_flag", "department": "trim(department) <> ''",
           "municipality": "trim(municipality) <> ''", "address": "trim(address) <> ''", "latitude_num": "latitude_num IS NOT NULL", "geo_confidence": "geo_confidence IS NOT NULL", "data_quality_score": "data_quality_score IS NOT NULL"}
add("variable_maturity", "variable usable_records usable_percent:4 maturity", lambda x: plan.variable_maturity(x.early), f"{_READY}, s AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS variable, count(*) FILTER ({_USABLE[c]}) AS usable_records, {_PART(f'count(*) FILTER ({_USABLE[c]})')} AS usable_percent, '{m}' AS maturity FROM rd1" for n, c, m in MATURITY) + ")", "s")
_SHARES = [("porcentaje_accidentes", "incident = 'TRAFFIC_ACCIDENT'"), ("porcentaje_eventos_con_lesionados", "injury_flag"), ("porcentaje_eventos_con_fallecidos", "fatality_flag"),
           ("porcentaje_usuarios_vulnerables", "vulnerable_user_flag"), ("porcentaje_con_direccion_util", "spatial_level = 'ADDRESS_TEXT'"), ("porcentaje_con_coordenada_puntual", "spatial_level = 'POINT'"),
           ("porcentaje_usables_con_geocodificacion", "ready = 'USABLE_CON_GEOCODIFICACION'")]


def _strongest(name: str, *keys: str) -> str:
    shown = " || ' / ' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (f"SELECT '{name}', value FROM (SELECT {shown} AS value, ROUND(sum(social_road_event_index_0_100), 6) AS s FROM rd1 GROUP BY {', '.join(keys)} ORDER BY s DESC, value DESC LIMIT 1)")


add("exploratory_indicators", "indicator value", lambda x: plan.exploratory_indicators(x.early, x.mentions.count()), f"{_READY}, s AS (SELECT 'eventos_deduplicados' AS indicator, CAST(CAST(count(*) AS DOUBLE) AS VARCHAR) AS value FROM rd1 UNION ALL "
    + " UNION ALL ".join(["SELECT 'menciones_expandidas', CAST(n AS VARCHAR) FROM mn", "SELECT 'menciones_promedio_por_evento', CAST(ROUND(avg(mentions), 2) AS VARCHAR) FROM rd1"]
                         + [f"SELECT '{n}', CAST({_PART(f'count(*) FILTER ({c})')} AS VARCHAR) FROM rd1" for n, c in _SHARES]
                         + [_strongest("dia_mayor_senal", "event_date"), _strongest("departamento_mayor_senal", "department_norm"), _strongest("municipio_mayor_senal", "department_norm", "municipality_norm")]) + ")", "s")

_ctx = f"""{EARLY}, c0 AS (SELECT *, concat_ws(' ', CASE WHEN trim(address) <> '' THEN {_norm('address')} END, obs, CASE WHEN trim(municipality) <> '' THEN mun2 END, CASE WHEN trim(department) <> '' THEN dep2 END) AS t FROM early),
c1 AS (SELECT *, CASE WHEN {one_of('mun2', CAPITAL_CORE)} THEN 'AMSS_CORE' WHEN {one_of('mun2', CAPITAL_EXTENDED)} THEN 'AMSS_EXTENDED' WHEN dep2 = 'san salvador' THEN 'SAN_SALVADOR_DEPARTMENT' WHEN {has('t', CAPITAL_HINTS)} THEN 'CAPITAL_TEXT_HINT' ELSE 'OUTSIDE_CAPITAL_SCOPE' END AS capital_scope FROM c0),
c2 AS (SELECT *, CASE WHEN capital_scope = 'OUTSIDE_CAPITAL_SCOPE' THEN 'OUTSIDE' {' '.join('WHEN ' + ' OR '.join(([one_of('mun2', m)] if m else []) + ([has('t', w)] if w else [])) + f' THEN {q(n)}' for n, m, w in CAPITAL_SUBAREAS)} ELSE 'CAPITAL_SIN_SUBAREA' END AS capital_subarea,
 CASE WHEN capital_scope = 'OUTSIDE_CAPITAL_SCOPE' THEN 'OUTSIDE_CAPITAL_SCOPE' WHEN aggregate_news_flag THEN 'CONTEXT_ONLY_MULTI_LOCATION' WHEN location_conflict_flag THEN 'REVIEW_LOCATION_CONFLICT' ELSE 'ELIGIBLE' END AS capital_analysis_status FROM c1)"""
add("capital_scope", "uuid capital_scope capital_subarea capital_analysis_status", lambda x: x.early, _ctx, STR("c2"))
add("capital_by_scope", "capital_scope events percent:4", lambda x: plan.capital_tables(x.early)["capital_by_scope"],
    f"{_ctx}, s AS (SELECT capital_scope, count(*) AS events, ROUND(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE)*100, 2) AS percent FROM c2 WHERE capital_scope <> 'OUTSIDE_CAPITAL_SCOPE' GROUP BY 1)", "s")


def _cut_capital(x: str) -> str:
    other = r"[^\p{L}\p{N}_]"  # RE2's word boundary knows ASCII only
    head = f"regexp_replace({x}, {q(rf'(^|{other})(?:{"|".join(CAPITAL_PHRASE_STOPS)})(?:$|{other}).*$')}, '\\1')"
    return f"regexp_replace(regexp_replace({head}, '\\s+', ' ', 'g'), '^[ ,.;:-]+|[ ,.;:-]+$', '', 'g')"


def _pair(p: str) -> str:
    a, b = (_cut_capital(f"regexp_extract(t, {q(p)}, {i})") for i in (1, 2))
    return f"CASE WHEN {a} <> '' AND {b} <> '' AND {a} <> {b} THEN {a} || ' / ' || {b} END"


_known = f"list_filter([{', '.join(f'CASE WHEN {has("t", a)} THEN {q(n)} END' for n, a in CAPITAL_CORRIDORS.items())}], lambda p: p IS NOT NULL)"
_found = f"regexp_extract_all(t, {q(rf'\b(?:{"|".join(CAPITAL_ROAD_WORDS)})\s+(?:[a-z0-9ªº.\-/]+\s*){{0,7}}')})"
_roads = f"""{_ctx}, k0 AS (SELECT *, list_sort({_known}) AS c_known, list_filter(list_transform({_found}, lambda p: {_cut_capital('p')}), lambda p: len(string_split(p, ' ')) >= 2) AS c_phr,
  list_sort(list_distinct(list_transform(regexp_extract_all(t, {q(CAPITAL_KM)}, 1), lambda n: 'km ' || replace(n, ' ', '')))) AS c_kms FROM c2),
k1 AS (SELECT *, list_sort(list_distinct(list_concat(c_known, c_phr))) AS c_roads FROM k0),
k2 AS (SELECT *, COALESCE(c_roads[1], '') AS pr, COALESCE({', '.join(_pair(p) for p in CROSSING_PATTERNS)},
  CASE WHEN len(c_roads) >= 2 AND (contains(t, ' interseccion ') OR contains(t, ' esquina ')) THEN c_roads[1] || ' / ' || c_roads[2] ELSE '' END) AS xi FROM k1),
k3 AS (SELECT *, COALESCE(c_known[1], pr) AS corridor, CASE WHEN pr <> '' THEN pr ELSE t END AS rt2,
  CASE WHEN xi <> '' THEN 'INTERSECTION_TEXT' WHEN len(c_kms) > 0 AND len(c_roads) > 0 THEN 'KM_REFERENCE_ON_ROAD' WHEN len(c_roads) > 0 THEN 'ROAD_NAME_EXTRACTED' WHEN len(c_kms) > 0 THEN 'KM_REFERENCE_ONLY' ELSE 'NO_ROAD_CONTEXT' END AS lvl FROM k2),
k4 AS (SELECT * EXCLUDE (uuid, corridor_candidate, intersection_candidate, primary_road_candidate, road_name_candidates, km_references, road_context_level, road_type_candidate), CAST(uuid AS VARCHAR) AS uuid, array_to_string(c_roads, '; ') AS road_name_candidates, array_to_string(c_kms, '; ') AS km_references, pr AS primary_road_candidate,
  xi AS intersection_candidate, corridor AS corridor_candidate, lvl AS road_context_level,
  CASE {' '.join(f"WHEN {has('rt2', w)} THEN {q(n)}" for n, w in ROAD_TYPE_TERMS)} WHEN contains(rt2, 'avenida') OR regexp_matches(rt2, '\\bav\\b') THEN 'ARTERIAL_O_COLECTORA_URBANA'
   WHEN contains(rt2, 'calle') THEN 'LOCAL_O_COLECTORA_URBANA' WHEN {has('rt2', NODE_TERMS)} THEN 'NODO_INTERSECCION' ELSE 'NO_CLASIFICADA' END AS road_type_candidate FROM k3)"""
add("capital_roads", "uuid road_name_candidates primary_road_candidate corridor_candidate intersection_candidate km_references road_context_level road_type_candidate", lambda x: x.early, _roads, "k4")
add("capital_corridors", "corridor events severity_sum:4 mentions_sum injury_events", lambda x: plan.capital_tables(x.early)["capital_corridors"],
    f"""{_roads}, s AS (SELECT corridor_candidate AS corridor, count(*) AS events, sum(severity_score) AS severity_sum, sum(mentions) AS mentions_sum, count(*) FILTER (injury_flag) AS injury_events
  FROM k4 WHERE capital_analysis_status = 'ELIGIBLE' AND road_context_level <> 'NO_ROAD_CONTEXT' AND corridor_candidate <> '' GROUP BY 1)""", "s")
for _n, _c in (("capital_road_context_level", "road_context_level"), ("capital_road_type", "road_type_candidate")):
    add(_n, f"{_c} events percent:4", lambda x, n=_n: plan.capital_tables(x.early)[n],
        f"{_roads}, s AS (SELECT {_c}, count(*) AS events, ROUND(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE)*100, 2) AS percent FROM k4 WHERE capital_analysis_status = 'ELIGIBLE' GROUP BY 1)", "s")
add("value_shares", "severity_class events percent:4", lambda x: share_table(x.early, "severity_class"),
    f"{EARLY}, s AS (SELECT severity_class, count(*) AS events, ROUND(count(*)/CAST(sum(count(*)) OVER () AS DOUBLE)*100, 2) AS percent FROM early GROUP BY 1)", "s")
add("spatial_match", "uuid text_match_status spatial_match_status geocode_status geocode_confidence:4", lambda x: x.evaluated)
add("bias_shares", "metric value:4", lambda x: plan.bias_shares(x.evaluated, x.mentions), f"""{EARLY},
b AS (SELECT 'eventos_unicos' AS metric, CAST(count(*) AS DOUBLE) AS value FROM early UNION ALL SELECT 'menciones_totales', sum(mentions) FROM early UNION ALL SELECT 'eventos_con_multiples_menciones', count(*) FILTER (mentions > 1) FROM early
 UNION ALL SELECT 'eventos_con_direccion_textual', count(*) FILTER (trim(address) <> '') FROM early UNION ALL SELECT 'eventos_con_coordenadas_originales', count(*) FILTER (coordinate_inside_sv_bbox) FROM early
 UNION ALL SELECT 'eventos_geocodificados_utiles_para_via', count(*) FILTER (coordinate_inside_sv_bbox AND (geo_confidence = 0 OR geo_confidence >= 0.55)) FROM early
 UNION ALL SELECT 'departamentos_con_eventos', count(DISTINCT department_norm) FILTER (department_norm <> 'SIN_DEPTO') FROM early
 UNION ALL SELECT 'concentracion_departamento_principal_pct', ROUND(max(n)/CAST(sum(n) AS DOUBLE)*100, 2) FROM (SELECT count(*) n FROM early WHERE department_norm <> 'SIN_DEPTO' GROUP BY department_norm)
 UNION ALL SELECT 'fuentes_distintas_menciones', count(DISTINCT mention) FROM ev UNION ALL SELECT 'concentracion_fuente_principal_pct', ROUND(max(n)/CAST(sum(n) AS DOUBLE)*100, 2) FROM (SELECT count(DISTINCT incident) n FROM ev GROUP BY mention))""", "b")
add("fitness_index", "component score_0_100:4 weight:4 weighted_score:4", lambda x: plan.fitness_index(x.evaluated, x.mentions))
add("fitness_decision", "decision", lambda x: plan.fitness_decision(plan.fitness_index(x.evaluated, x.mentions)))
add("evaluation_funnel", "metric value:4", lambda x: plan.evaluation_funnel(x.evaluated))
add("review_sample", "uuid spatial_match_status severity_score:4 mentions manual_notes", lambda x: plan.review_sample(x.evaluated))
