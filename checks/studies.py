"""Study queries."""

from __future__ import annotations

from checks.incidents import CRITICAL
from checks.quality import CONFLICTS
from checks.registry import add
from checks.sql import JAMS, q, road, tcompact
from corridor_spark.lexicons import WEIGHT_PROFILES
from corridor_spark.plans import quality, studies as plan
from corridor_spark.sources import roads

REFS = ("ca 1", "ca 3", "ca 5", "ca 6", "rn 10")
_T = ", ".join(q(r) for r in REFS)
TOUCH = f"""{JAMS},
tg AS (SELECT unnest([{_T}]) AS ref_norm),
tj AS (SELECT ref_norm, j.* FROM jams j JOIN tg ON contains(replace({tcompact("array_to_string(j.refs, ';')")}, ' ', ''), replace(ref_norm, ' ', '')) OR contains(replace({tcompact('street_modal')}, ' ', ''), replace(ref_norm, ' ', ''))),
te AS (SELECT ref_norm, count(*) AS waze_jams, count(DISTINCT event_hour) AS active_hours, ROUND(sum(delay_min), 3) AS waze_delay_min, ROUND(sum(length_km), 3) AS waze_length_km,
 ROUND(sum(jam_intensity_score), 3) AS waze_intensity, ROUND(avg(CAST(severe_jam_flag AS INT))*100, 2) AS waze_severe_rate, ROUND(avg(speed_min), 3) AS waze_avg_speed_min FROM tj GROUP BY 1)"""
STUDY = f"""{TOUCH},
cx AS (SELECT c.ref_norm, 'c' AS side, 0e0 AS m, representative_name AS nm, CASE WHEN contains(' ' || array_to_string(list_transform(ref_list, lambda r: lower(replace(r, '-', ' '))), ' ') || ' ', ' ' || c.ref_norm || ' ') THEN 'EXACT' END AS rel FROM cat, tg c),
sx AS (SELECT c.ref_norm, 's' AS side, length_m AS m, name AS nm, CASE WHEN lower(replace(ref, '-', ' ')) = c.ref_norm THEN 'EXACT' END AS rel FROM seg, tg c),
ox AS (SELECT ref_norm, count(*) FILTER (side = 'c') AS osm_catalog_rows, count(*) FILTER (side = 's') AS osm_segment_rows, ROUND(sum(m)/1000, 3) AS osm_length_km,
  count(*) FILTER (trim(nm) <> '') AS named FROM (SELECT * FROM cx UNION ALL SELECT * FROM sx) WHERE rel IS NOT NULL GROUP BY 1),
st AS (SELECT ref_norm, COALESCE(waze_jams, 0) AS waze_jams, COALESCE(active_hours, 0) AS active_hours, COALESCE(waze_delay_min, 0) AS waze_delay_min, COALESCE(waze_length_km, 0) AS waze_length_km, COALESCE(waze_intensity, 0) AS waze_intensity,
  COALESCE(waze_severe_rate, 0) AS waze_severe_rate, COALESCE(waze_avg_speed_min, 0) AS waze_avg_speed_min, COALESCE(osm_catalog_rows, 0) AS osm_catalog_rows, COALESCE(osm_segment_rows, 0) AS osm_segment_rows, COALESCE(osm_length_km, 0) AS osm_length_km,
  CASE WHEN osm_catalog_rows > 0 THEN 'EXACT' ELSE 'NO_REF' END AS osm_ref_relation,
  CASE WHEN osm_catalog_rows > 0 AND named > 0 AND waze_jams > 0 THEN 'NORMALIZABLE_SEMI_AUTOMATICO' WHEN osm_catalog_rows > 0 AND waze_jams > 0 THEN 'NORMALIZABLE_CON_ALIAS_CURADO' WHEN waze_jams >= 20 THEN 'NORMALIZABLE_SOLO_CON_VALIDACION'
   WHEN waze_jams > 0 THEN 'CONSERVAR_REF_TECNICA' ELSE 'SIN_EVIDENCIA_LOCAL' END AS normalization_decision FROM tg LEFT JOIN te USING (ref_norm) LEFT JOIN ox USING (ref_norm))"""
_META = {r: (r.upper(), f"Corredor {r}", "NACIONAL_REGIONAL", "CORREDOR_ESTRUCTURANTE", "SEMI_CURADA_ALTA" if r != "ca 3" else "SEMI_CURADA_MEDIA") for r in REFS}
add("reference_evidence", "ref_norm waze_jams active_hours waze_delay_min:4 waze_length_km:4 waze_intensity:4 waze_severe_rate:4 waze_avg_speed_min:4 osm_catalog_rows osm_segment_rows osm_length_km:4 osm_ref_relation normalization_decision",
    lambda x: plan.reference_study(x.jams, x.catalog, x.segments, REFS), STUDY, "st")
add("reference_examples", "ref_norm uuid example_rank jam_intensity_score:4", lambda x: plan.reference_examples(x.jams, REFS),
    f"{TOUCH}, ex AS (SELECT ref_norm, uuid, CAST(row_number() OVER (PARTITION BY ref_norm ORDER BY jam_intensity_score DESC, uuid) AS INT) AS example_rank, jam_intensity_score FROM tj)", "(SELECT * FROM ex WHERE example_rank <= 25)")
add("alias_proposals", "raw_value raw_value_norm corridor_norm priority", lambda x: plan.alias_proposals(plan.reference_study(x.jams, x.catalog, x.segments, REFS), _META),
    f"{STUDY}, ap AS (SELECT unnest([upper(ref_norm), replace(upper(ref_norm), ' ', '-')]) AS raw_value, ref_norm AS raw_value_norm, 'Corredor ' || ref_norm AS corridor_norm, CASE WHEN ref_norm = 'ca 3' THEN 75 ELSE 88 END AS priority "
    "FROM st WHERE normalization_decision NOT IN ('SIN_EVIDENCIA_LOCAL', 'CONSERVAR_REF_TECNICA'))", "ap")

_KEYS = f"(SELECT {tcompact('p')} FROM (SELECT unnest(list_concat([road_key_norm, representative_name], ref_list)) AS p FROM cat) UNION SELECT {tcompact('name')} FROM seg)"
_stage = lambda name, expr, keys, alias: (
    f"SELECT '{name}' AS stage, count(*) FILTER ({expr} <> '') AS records_with_signal, ROUND(count(*) FILTER ({expr} <> '')/CAST(count(*) AS DOUBLE)*100, 2) AS coverage_pct, count(DISTINCT {expr}) FILTER ({expr} <> '') AS unique_values, "
    + (f"count(*) FILTER ({expr} <> '' AND {expr} IN {keys})" if keys else "NULL") + " AS osm_exact_matches, "
    + (f"count(*) FILTER (EXISTS (SELECT 1 FROM alias_lookup WHERE contains({expr}, key)))" if alias else "NULL") + " AS alias_matches, NULL AS final_resolved FROM jams")
_keep = f"(SELECT * FROM {_KEYS} t(k) WHERE k <> '' AND NOT starts_with(k, 'osm way'))"
_keep_road = f"(SELECT {road('k')} FROM {_KEYS} t(k) WHERE k <> '' AND NOT starts_with(k, 'osm way'))"
add("norm_stages", "stage records_with_signal coverage_pct:4 unique_values osm_exact_matches alias_matches final_resolved",
    lambda x: plan.normalization_stages(x.jams, roads.road_keys(x.catalog, False), roads.road_keys(x.catalog, True), x.lookups.aliases),
    f"{JAMS}, ns AS (" + " UNION ALL ".join([_stage("raw_street", "trim(street_modal)", None, False), _stage("compact_text", tcompact("street_modal"), _keep, True),
                                             _stage("road_normalized", road("street_modal"), _keep_road, True), _stage("combined_text_alias", road("street_modal"), None, True),
    "SELECT 'final_pipeline', count(*) FILTER (corridor_match_status = 'RESOLVED'), ROUND(count(*) FILTER (corridor_match_status = 'RESOLVED')/CAST(count(*) AS DOUBLE)*100, 2), count(DISTINCT corridor_norm_group), "
    "count(*) FILTER (corridor_match_method IN ('OSM_NAME', 'OSM_REF')), count(*) FILTER (corridor_match_method IN ('TEXT_ALIAS', 'TEXT_ALIAS_TABLE')), count(*) FILTER (corridor_match_status = 'RESOLVED') FROM jams"]) + ")", "ns")
add("remaining_terms", "issue_type street_norm corridor_norm_group cases max_intensity:4 avg_delay_min:4 avg_length_km:4", lambda x: plan.remaining_terms(quality.jam_conflicts(x.jams)),
    f"{CONFLICTS}, rt AS (SELECT issue_type, {road('street_modal')} AS street_norm, jc.corridor_norm_group, count(DISTINCT uuid) AS cases, max(jc.jam_intensity_score) AS max_intensity, avg(delay_min) AS avg_delay_min, avg(length_km) AS avg_length_km "
    f"FROM jc JOIN jams USING (uuid) WHERE issue_type IN ({', '.join(q(i) for i in plan.REMAINING_ISSUES)}) GROUP BY 1, 2, 3)", "rt")

_score = lambda w: "ROUND(100 * (" + " + ".join(f"CAST({c} AS DOUBLE)/GREATEST(max({c}) OVER (), 1)*{v}e0" for c, v in w.items()) + "), 4)"
WEIGHTS = f"""{CRITICAL}, ws AS ({' UNION ALL '.join(f"SELECT corridor_norm AS corridor, '{p}' AS profile, {_score(w)} AS score_0_100 FROM critical" for p, w in WEIGHT_PROFILES.items())}),
wr AS (SELECT *, rank() OVER (PARTITION BY profile ORDER BY score_0_100 DESC) AS rank FROM ws)"""
add("weight_profiles", "corridor profile score_0_100:4 rank", lambda x: plan.weight_profiles(*plan.base_corridors([x.critical.limit(0), x.critical])), WEIGHTS, "wr")
add("rank_sensitivity", "corridor rank_A_RECURRENCIA_VOLUMEN score_B_SEVERIDAD:4 ranking_promedio:4 desviacion_estandar_ranking:4 score_promedio_normalizado:4 frecuencia_top_3 frecuencia_top_5 frecuencia_top_10 clasificacion_robustez",
    lambda x: plan.rank_sensitivity(plan.weight_profiles(x.critical)), f"""{WEIGHTS},
rs AS (SELECT corridor, min(rank) FILTER (profile = 'A_RECURRENCIA_VOLUMEN') AS rank_A_RECURRENCIA_VOLUMEN, max(score_0_100) FILTER (profile = 'B_SEVERIDAD') AS score_B_SEVERIDAD, ROUND(avg(rank), 2) AS ranking_promedio,
 ROUND(stddev_pop(rank), 2) AS desviacion_estandar_ranking, ROUND(avg(score_0_100), 2) AS score_promedio_normalizado, {', '.join(f'count(*) FILTER (rank <= {k}) AS frecuencia_top_{k}' for k in (3, 5, 10))} FROM wr GROUP BY 1),
rz AS (SELECT *, CASE WHEN frecuencia_top_5 >= 3 THEN 'ROBUSTO' WHEN frecuencia_top_5 = 1 THEN 'DEPENDIENTE_DEL_ENFOQUE' WHEN frecuencia_top_5 = 0 THEN 'NO_PRIORITARIO' ELSE 'INTERMEDIO' END AS clasificacion_robustez FROM rs)""", "rz")
