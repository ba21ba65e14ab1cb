"""Incident queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import add
from checks.sql import ROADS, compact, distance, has, ladder, one_of, q, wsum
from corridor_spark.fixtures import cte
from corridor_spark.lexicons import (
    DEPARTMENT_NAMES, EVENT_SCORE_CLASSES, FATALITY_WORDS, GEO_COMPONENT, INCIDENT_DISTANCE, INCIDENT_DISTANCE_FAR,
    INCIDENT_RULES, INJURY_WORDS, KNOWN_CORRIDORS, MAJOR_HIGHWAYS, MUNICIPALITY_NAMES, NODE_TERMS, NUMBER_WORDS, PHRASE_STOPS,
    ROAD_COMPONENT, ROAD_FILLERS, ROAD_KINDS, ROAD_TYPE_TERMS, SEVERITY_BONUS, SEVERITY_TERMS, TITLE_SMALL_WORDS,
    WEIGHT_PROFILES,
)
from corridor_spark.plans import incidents as plan
from corridor_spark.sources import incidents as source

E = ("likes", "comments", "shares", "quotes", "views")

EVIDENCE = f"""{cte('snapshot', 'incident_text')},
ev AS (SELECT s.*, row_number() OVER (PARTITION BY incident, mention ORDER BY snapshot_index) - 1 AS pos,
              row_number() OVER (PARTITION BY incident, mention ORDER BY snapshot_index DESC) AS from_end,
              row_number() OVER (PARTITION BY incident, mention ORDER BY captured_at DESC, snapshot_index DESC) AS newest
       FROM snapshot s WHERE incident IN (SELECT uuid FROM incident_text))"""

add("mentions", "event_uuid mention_id source engagement_snapshots latest_likes:2 latest_comments:2 latest_shares:2 latest_quotes:2 latest_views:2",
    lambda x: x.mentions, f"""{EVIDENCE}, m AS (SELECT CAST(incident AS VARCHAR) AS event_uuid, mention AS mention_id, 'src_' || mention AS source,
 CAST(count(*) AS INT) AS engagement_snapshots, {', '.join(f'max({e}) FILTER (from_end = 1) AS latest_{e}' for e in E)} FROM ev GROUP BY 1, 2, 3)""", "m")

add("snapshots", "event_uuid mention_id source snapshot_index likes:2 comments:2 shares:2 quotes:2 views:2", lambda x: x.snapshots,
    f"""{EVIDENCE}, s2 AS (SELECT CAST(incident AS VARCHAR) AS event_uuid, mention AS mention_id, 'src_' || mention AS source, CAST(pos AS INT) AS snapshot_index, {', '.join(E)} FROM ev)""", "s2")

add("latest_engagement", "event_uuid latest_likes:2 latest_comments:2 latest_shares:2 latest_quotes:2 latest_views:2 engagement_mentions engagement_snapshots",
    lambda x: source.latest_engagement(x.mentions), f"""{EVIDENCE}, l AS (SELECT CAST(incident AS VARCHAR) AS event_uuid,
 {', '.join(f'sum({e}) FILTER (newest = 1) AS latest_{e}' for e in E)}, count(DISTINCT mention) AS engagement_mentions, count(*) AS engagement_snapshots FROM ev GROUP BY 1)""", "l")

add("engagement_by_source", "source menciones eventos latest_likes:2 latest_comments:2 latest_shares:2 latest_quotes:2 latest_views:2",
    lambda x: plan.engagement_by_source(x.mentions), f"""{EVIDENCE}, b AS (SELECT 'src_' || mention AS source, count(DISTINCT incident) AS menciones, count(DISTINCT incident) AS eventos,
 {', '.join(f'sum({e}) FILTER (from_end = 1) AS latest_{e}' for e in E)} FROM ev GROUP BY 1)""", "b")

add("engagement_by_hour", "captured_date captured_hour snapshots likes:2 comments:2 shares:2 quotes:2 views:2",
    lambda x: plan.engagement_by_hour(x.snapshots), f"""{EVIDENCE}, b AS (SELECT CAST(captured_at AS DATE) AS captured_date, CAST(hour(captured_at) AS INT) AS captured_hour, count(*) AS snapshots,
 {', '.join(f'sum({e}) AS {e}' for e in E)} FROM ev GROUP BY 1, 2)""", "b")


def _title(x: str) -> str:
    small = ", ".join(q(w) for w in TITLE_SMALL_WORDS)
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w "
            f"ELSE upper(w[1:1]) || w[2:] END), ' ')")


def _lookup(x: str, table: dict, default: str) -> str:
    text = lambda v: q(v) if isinstance(v, str) else f"{v}e0"
    return f"CASE {x} {' '.join(f'WHEN {q(k)} THEN {text(v)}' for k, v in table.items())} ELSE {default} END"


def _near(words: str) -> str:
    n = rf"(\d+|{'|'.join(NUMBER_WORDS)})"
    number = _lookup("w", {k: v for k, v in NUMBER_WORDS.items()}, "TRY_CAST(w AS DOUBLE)")
    found = (f"list_concat(regexp_extract_all(obs, {q(rf'{n}\s+(?:personas?\s+)?{words}')}, 1), "
             f"regexp_extract_all(obs, {q(rf'{words}\s+(?:a\s+)?{n}\s+(?:personas?)?')}, 1))")
    return f"CAST(COALESCE(list_max(list_transform({found}, lambda w: {number})), 0) AS BIGINT)"


def _cut(x: str) -> str:
    head = f"regexp_replace({x}, {q(rf'\b(?:{"|".join(PHRASE_STOPS)})\b.*$')}, '')"
    return f"trim(regexp_replace(trim({head}), {q(r'\b(?:del|de la|de los|de las)$')}, ''))"


KINDS, FILLERS = f"[{', '.join(q(w) for w in ROAD_KINDS)}]", f"[{', '.join(q(w) for w in ROAD_FILLERS)}]"
_valid = (f"len(string_split(p, ' ')) >= 2 AND NOT (list_contains({KINDS}, string_split(p, ' ')[1]) AND list_has_all({FILLERS}, string_split(p, ' ')[2:])) "
          f"AND NOT (len(string_split(p, ' ')) <= 3 AND list_has_all(list_concat({KINDS}, {FILLERS}), string_split(p, ' ')))")
PHRASES = (f"list_filter(list_transform(regexp_extract_all(txt, {q(rf'\b(?:{"|".join(ROAD_KINDS)})\s+(?:[a-z0-9]+\s*){{0,9}}')}), "
           f"lambda p: {_cut('trim(p)')}), lambda p: {_valid})")
KNOWN = f"list_filter([{', '.join(f'CASE WHEN {has("txt", a)} THEN {q(n)} END' for n, a in KNOWN_CORRIDORS.items())}], lambda p: p IS NOT NULL)"
_END = r"(?:,|;| en |$)"
_CROSS = (rf"interseccion de la? (.+?) y la? (.+?){_END}", rf"interseccion de (.+?) y (.+?){_END}",
          rf"(.+? avenida .+?) y (.+? calle .+?){_END}", rf"(.+? calle .+?) y (.+? avenida .+?){_END}")


def _pair(p: str) -> str:
    a, b = _cut(f"regexp_extract(txt, {q(p)}, 1)"), _cut(f"regexp_extract(txt, {q(p)}, 2)")
    return f"CASE WHEN {a} <> '' AND {b} <> '' AND {a} <> {b} THEN {a} || ' / ' || {b} END"


TEXTS = f"""{EVIDENCE},
tx AS (SELECT *, {compact('observation')} AS obs, {compact('address')} AS addr, {compact('incident')} AS inc,
              {compact('department')} AS dep, {compact('municipality')} AS mun FROM incident_text),
fl AS (SELECT *, addr || ' ' || obs AS txt, {', '.join(f'{has("obs", t)} AS {n}' for n, t in SEVERITY_TERMS.items())},
              {_near(INJURY_WORDS)} AS injury_count_text, {_near(FATALITY_WORDS)} AS fatality_count_text FROM tx),
kn AS (SELECT *, list_sort({KNOWN}) AS known, {PHRASES} AS phrases,
              list_sort(list_distinct(list_transform(regexp_extract_all(txt, '\\b(?:kilometro|km)\\s*([0-9]+)', 1), lambda n: 'km ' || n))) AS kms FROM fl),
rd AS (SELECT *, list_sort(list_distinct(list_concat(known, phrases))) AS roads FROM kn),
cr AS (SELECT *, COALESCE(roads[1], '') AS primary_road_candidate,
              COALESCE({', '.join(_pair(p) for p in _CROSS)}, CASE WHEN len(roads) >= 2 AND (contains(txt, ' interseccion ') OR contains(txt, ' esquina ')) THEN roads[1] || ' / ' || roads[2] ELSE '' END) AS intersection_candidate
       FROM rd),
texts AS (SELECT *, array_to_string(roads, '; ') AS road_name_candidates, array_to_string(kms, '; ') AS km_references,
   COALESCE(known[1], primary_road_candidate) AS corridor_candidate,
   CASE WHEN fatality_flag THEN 'FATALITY_REPORTED' WHEN injury_flag THEN 'INJURY_REPORTED' WHEN material_damage_only_flag THEN 'MATERIAL_DAMAGE_ONLY'
        WHEN inc = 'traffic accident' THEN 'TRAFFIC_ACCIDENT_UNSPECIFIED' WHEN obstruction_flag THEN 'ROAD_AFFECTATION' ELSE 'OTHER_LOW_INFORMATION' END AS severity_class,
   ROUND(LEAST(GREATEST(CASE WHEN fatality_flag THEN 0.9e0 + LEAST(fatality_count_text, 3)*0.03e0 WHEN injury_flag THEN 0.5e0 + LEAST(injury_count_text, 6)*0.05e0
        WHEN material_damage_only_flag THEN 0.2e0 WHEN inc = 'traffic accident' THEN 0.32e0 WHEN obstruction_flag THEN 0.22e0 ELSE 0.12e0 END
        {' '.join(f'+ CASE WHEN {f} THEN {b}e0 ELSE 0e0 END' for f, b in SEVERITY_BONUS)}, 0), 1), 4) AS severity_score,
   CASE WHEN intersection_candidate <> '' THEN 'INTERSECTION_TEXT' WHEN len(kms) > 0 AND len(roads) > 0 THEN 'KM_REFERENCE_ON_ROAD' WHEN len(roads) > 0 THEN 'ROAD_NAME_EXTRACTED'
        WHEN len(kms) > 0 THEN 'KM_REFERENCE_ONLY' ELSE 'NO_ROAD_CONTEXT' END AS road_context_level,
   CASE WHEN primary_road_candidate <> '' THEN primary_road_candidate ELSE txt END AS rt
   FROM cr),
texts2 AS (SELECT *, CASE {' '.join(f"WHEN {has('rt', w)} THEN {q(n)}" for n, w in ROAD_TYPE_TERMS)} WHEN contains(rt, 'avenida') OR regexp_matches(rt, '\\bav\\b') THEN 'ARTERIAL_O_COLECTORA_URBANA'
   WHEN contains(rt, 'calle') THEN 'LOCAL_O_COLECTORA_URBANA' WHEN {has('rt', NODE_TERMS)} THEN 'NODO_INTERSECCION' ELSE 'NO_CLASIFICADA' END AS road_type_candidate,
   CASE WHEN dep = '' THEN 'SIN_DEPTO' ELSE COALESCE({_lookup('dep', DEPARTMENT_NAMES, 'NULL')}, upper({_title('dep')})) END AS department_norm,
   CASE WHEN mun = '' THEN 'SIN_MUNICIPIO' ELSE COALESCE({_lookup('mun', MUNICIPALITY_NAMES, 'NULL')}, {_title('mun')}) END AS municipality_norm,
   CASE WHEN dep <> '' AND mun <> '' THEN 'DEPARTMENT_AND_MUNICIPALITY' WHEN dep <> '' THEN 'DEPARTMENT_ONLY' WHEN mun <> '' THEN 'MUNICIPALITY_ONLY' ELSE 'NO_TERRITORY_FIELDS' END AS territory_normalization_status
   FROM texts)"""

add("severity", "uuid severity_class severity_score:4 fatality_flag injury_flag material_damage_only_flag vulnerable_user_flag motorcycle_flag "
    "pedestrian_flag heavy_vehicle_flag obstruction_flag multi_vehicle_flag injury_count_text fatality_count_text",
    lambda x: x.base_events, TEXTS.replace("texts2 AS", "texts2 AS", 1), "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM texts2)")

add("number_near_keyword", "uuid injury_count_text fatality_count_text", lambda x: x.base_events, TEXTS,
    "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM texts2)")

add("road_phrases", "uuid road_name_candidates primary_road_candidate corridor_candidate intersection_candidate km_references road_context_level road_type_candidate",
    lambda x: x.base_events, TEXTS, "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM texts2)")

BASE = f"""{TEXTS},
lt AS (SELECT incident AS uuid, {', '.join(f'sum({e}) FILTER (newest = 1) AS latest_{e}' for e in E)}, count(DISTINCT mention) AS engagement_mentions, count(*) AS engagement_snapshots FROM ev GROUP BY 1),
mc AS (SELECT incident AS uuid, count(DISTINCT mention) AS n FROM snapshot GROUP BY 1),
ek AS (SELECT t.* EXCLUDE (uuid), t.uuid, {', '.join(f'COALESCE(latest_{e}, 0e0) AS latest_{e}' for e in E)}, COALESCE(engagement_mentions, 0) AS engagement_mentions,
   COALESCE(engagement_snapshots, 0) AS engagement_snapshots, COALESCE(mc.n, 0) AS mentions, COALESCE(mc.n, 0) AS source_diversity,
   lat AS latitude_num, lon AS longitude_num, lat IS NOT NULL AND lon IS NOT NULL AS coordinate_pair_present,
   COALESCE(lat BETWEEN 13.0 AND 14.6 AND lon BETWEEN -90.2 AND -87.6, false) AS coordinate_inside_sv_bbox,
   COALESCE(lat BETWEEN 13.55 AND 13.92 AND lon BETWEEN -89.42 AND -89.00, false) AS coordinate_inside_amss_bbox,
   CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN printf('%.6f,%.6f', lat, lon) ELSE '' END AS coordinate_key_6dec,
   CAST(datetime AS TIMESTAMP) AS event_datetime
   FROM texts2 t LEFT JOIN lt USING (uuid) LEFT JOIN mc USING (uuid)),
be AS (SELECT *, CASE WHEN coordinate_key_6dec = '' THEN 0 ELSE count(*) OVER (PARTITION BY coordinate_key_6dec) END AS coordinate_reuse_count,
   CAST(event_datetime AS DATE) AS event_date, CAST(hour(event_datetime) AS INT) AS event_hour,
   ROUND(latest_likes + latest_comments*2 + latest_shares*3 + latest_quotes*3 + ln(1 + GREATEST(latest_views, 0)), 4) AS impact_social_score,
   ROUND(latest_likes + latest_comments + latest_shares + latest_quotes + latest_views, 4) AS impact_raw_sum,
   addr <> '' AS has_address, mun <> '' AS has_municipality, dep <> '' AS has_department FROM ek),
base AS (SELECT *, coordinate_reuse_count > 1 AS repeated_coordinate_flag, road_context_level <> 'NO_ROAD_CONTEXT' AS road_context_available,
   CASE WHEN NOT coordinate_pair_present THEN 'MISSING_POINT' WHEN NOT coordinate_inside_sv_bbox THEN 'OUTSIDE_EL_SALVADOR_BBOX' WHEN geo_confidence < 0.5 THEN 'LOW_GEO_CONFIDENCE_POINT'
        WHEN coordinate_reuse_count > 1 THEN 'VALID_POINT_REPEATED_COORDINATE' ELSE 'VALID_POINT' END AS coordinate_quality_status FROM be)"""
STR = "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM {})".format

add("coordinate_quality", "uuid coordinate_pair_present coordinate_inside_sv_bbox coordinate_inside_amss_bbox coordinate_key_6dec coordinate_reuse_count repeated_coordinate_flag coordinate_quality_status",
    lambda x: x.base_events.withColumn("coordinate_reuse_count", F.col("coordinate_reuse_count").cast("bigint")), BASE, STR("base"))

add("event_rows", "uuid event_date event_hour mentions source_diversity engagement_mentions engagement_snapshots latest_likes:4 latest_views:4 impact_social_score:4 impact_raw_sum:4 "
    "geo_confidence:4 has_address has_municipality has_department department_norm municipality_norm territory_normalization_status",
    lambda x: x.base_events, BASE, STR("base"))

# --- nearest road and resolution ---------------------------------------------

EVENTS = f"""{ROADS}, {BASE},
sc AS (SELECT b.*, CASE WHEN department_norm IN (SELECT source_department FROM seg) THEN 'DEPARTMENT' ELSE 'NATIONAL' END AS nearest_osm_source_scope FROM base b),
pr AS (SELECT e.uuid, r.way_id, r.name, r.ref, r.highway, r.road_key_norm, r.road_type_category, {distance('e.lon', 'e.lat')} AS d
   FROM sc e JOIN seg r ON coordinate_inside_sv_bbox AND (nearest_osm_source_scope = 'NATIONAL' OR r.source_department = e.department_norm)
     AND e.lon BETWEEN LEAST(ax, bx) - 0.035 AND GREATEST(ax, bx) + 0.035 AND e.lat BETWEEN LEAST(ay, by_) - 0.035 AND GREATEST(ay, by_) + 0.035),
nr AS (SELECT uuid, way_id AS nearest_osm_way_id, name AS nearest_osm_name, ref AS nearest_osm_ref, highway AS nearest_osm_highway, road_key_norm AS nearest_osm_road_key_norm,
   road_type_category AS nearest_osm_road_type, ROUND(d, 2) AS nearest_osm_distance_m FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY floor(d*1e6+0.5), way_id) rn FROM pr) WHERE rn = 1),
e1 AS (SELECT s.*, nr.* EXCLUDE (uuid), CASE WHEN coordinate_quality_status = 'MISSING_POINT' THEN 'NO_COORDINATE_FOR_OSM' WHEN coordinate_quality_status = 'OUTSIDE_EL_SALVADOR_BBOX' THEN 'INVALID_POINT_FOR_OSM'
   ELSE {ladder('nearest_osm_distance_m', INCIDENT_DISTANCE, INCIDENT_DISTANCE_FAR, 'NO_NEAR_OSM_SEGMENT')} END AS osm_match_status,
   {compact('corridor_candidate')} AS cc, {compact("concat_ws(' ', COALESCE(nearest_osm_name, ''), COALESCE(nearest_osm_ref, ''), COALESCE(nearest_osm_road_key_norm, ''))")} AS oc
   FROM sc s LEFT JOIN nr USING (uuid)),
e2 AS (SELECT *, CASE WHEN cc = '' THEN 'NO_TEXT_TO_VALIDATE' WHEN oc = '' THEN 'NO_OSM_TO_VALIDATE' WHEN contains(oc, cc) OR contains(cc, oc) THEN 'TEXT_SPATIAL_CONSISTENT'
   WHEN len(list_intersect(string_split(cc, ' '), string_split(oc, ' '))) / CAST(len(list_distinct(list_concat(string_split(cc, ' '), string_split(oc, ' ')))) AS DOUBLE) >= 0.45 THEN 'TEXT_SPATIAL_REVIEW'
   ELSE 'TEXT_SPATIAL_CONFLICT' END AS text_spatial_consistency,
   ' ' || {compact("concat_ws(' ', corridor_candidate, road_name_candidates, address, observation)")} || ' ' AS full_text,
   ' ' || {compact("COALESCE(nearest_osm_ref, '')")} || ' ' AS rref, ' ' || {compact("COALESCE(nearest_osm_name, '')")} || ' ' AS rname,
   ' ' || {compact("concat_ws(' ', address, observation, corridor_candidate)")} || ' ' AS ctx FROM e1)"""


def _rule(text: str, field: int) -> str:
    return "CASE " + " ".join(f"WHEN {has(text, [f' {p} ' for p in r[field]])} THEN {q(r[0])}" for r in INCIDENT_RULES if r[field]) + " END"


EVENTS += f""",
e3 AS (SELECT *, COALESCE({_rule('full_text', 1)}, {_rule('full_text', 2)}) AS ruled, {_rule('rref', 1)} AS by_ref, {_rule('rname', 2)} AS by_name FROM e2),
e4 AS (SELECT *, COALESCE(ruled, {_title('cc')}) AS tn, CASE WHEN ruled IS NOT NULL THEN 'TEXT_ALIAS' WHEN {one_of('cc', KNOWN_CORRIDORS)} THEN 'MANUAL_RULE' WHEN corridor_candidate <> '' THEN 'TEXT_ALIAS' ELSE 'UNRESOLVED' END AS ts_,
   COALESCE(by_ref, by_name, {_title('trim(rname)')}) AS onm, CASE WHEN by_ref IS NOT NULL THEN 'OSM_REF' WHEN trim(rname) <> '' THEN 'OSM_NAME' ELSE 'UNRESOLVED' END AS os,
   COALESCE(nearest_osm_name, '') <> '' OR COALESCE(nearest_osm_ref, '') <> '' AS has_road FROM e3),
e5 AS (SELECT *, tn <> '' AND tn = onm AS eq_, tn <> '' AND has_road AND osm_match_status IN ('SPATIAL_OSM_HIGH', 'SPATIAL_OSM_MEDIUM') AS nearby,
   intersection_candidate <> '' OR contains(ctx, ' interseccion ') OR contains(ctx, ' y ') AS crossing,
   ts_ = 'MANUAL_RULE' OR {one_of(compact('tn'), KNOWN_CORRIDORS)} OR {one_of(compact('tn'), ['carretera panamericana', 'autopista a comalapa', 'carretera al puerto de la libertad', 'paseo general escalon', 'carretera quezaltepeque san juan opico'])} AS strong FROM e4),
e6 AS (SELECT *, CASE WHEN eq_ THEN 'COMPATIBLE' WHEN nearby AND crossing THEN 'INTERSECTION_ACCEPTED' WHEN nearby AND nearest_osm_distance_m <= 50 AND strong THEN 'LOCAL_NAME_WITHIN_CORRIDOR'
   WHEN nearby THEN 'REVIEW_COORDINATE_OR_NAME' WHEN onm <> '' AND os <> 'UNRESOLVED' THEN CASE WHEN tn = '' THEN 'COMPATIBLE' ELSE 'REVIEW_COORDINATE_OR_NAME' END ELSE 'UNRESOLVED' END AS text_osm_resolution,
   CASE WHEN eq_ OR nearby THEN tn WHEN onm <> '' AND os <> 'UNRESOLVED' THEN onm ELSE tn END AS corridor_norm,
   CASE WHEN eq_ THEN CASE WHEN os IN ('OSM_REF', 'OSM_NAME') THEN os ELSE ts_ END WHEN nearby THEN ts_ WHEN onm <> '' AND os <> 'UNRESOLVED' THEN os WHEN tn <> '' THEN ts_ ELSE 'UNRESOLVED' END AS corridor_norm_source,
   CASE WHEN eq_ THEN CASE WHEN osm_match_status = 'SPATIAL_OSM_HIGH' THEN 'HIGH' ELSE 'MEDIUM' END WHEN nearby AND (crossing OR (nearest_osm_distance_m <= 50 AND strong)) THEN 'MEDIUM' WHEN nearby THEN 'LOW'
        WHEN onm <> '' AND os <> 'UNRESOLVED' THEN 'MEDIUM' ELSE 'LOW' END AS corridor_resolution_confidence, tn AS text_corridor_norm FROM e5),
e7 AS (SELECT *, severity_score*100 AS severity_component, LEAST(ln(1+mentions)/ln(1+GREATEST(max(mentions) OVER (), 1)), 1)*100 AS mentions_component, LEAST(source_diversity/3e0, 1)*100 AS source_diversity_component,
   LEAST(ln(1+impact_social_score)/ln(1+GREATEST(max(impact_social_score) OVER (), 1)), 1)*100 AS impact_social_component, {_lookup('coordinate_quality_status', GEO_COMPONENT, '0e0')} AS geo_quality_component,
   {_lookup('osm_match_status', ROAD_COMPONENT, '0e0')} AS osm_association_component,
   (epoch(event_datetime) - min(epoch(event_datetime)) OVER ()) / GREATEST(max(epoch(event_datetime)) OVER () - min(epoch(event_datetime)) OVER (), 1) * 100 AS temporal_recency_component FROM e6),
e8 AS (SELECT *, ROUND({wsum((.20, 'severity_component'), (.16, 'mentions_component'), (.12, 'source_diversity_component'), (.22, 'impact_social_component'), (.14, 'geo_quality_component'), (.10, 'osm_association_component'), (.06, 'temporal_recency_component'))}, 2) AS metric_score_0_100 FROM e7),
events_ AS (SELECT *, CASE {' '.join(f"WHEN metric_score_0_100 <= {u} THEN {q(n)}" for u, n in EVENT_SCORE_CLASSES)} END AS metric_category FROM e8)"""

add("nearest_cascade", "uuid nearest_osm_source_scope nearest_osm_way_id nearest_osm_name nearest_osm_highway nearest_osm_distance_m:4 osm_match_status",
    lambda x: x.events, EVENTS, STR("events_"))
add("resolve_incident", "uuid corridor_norm corridor_norm_source text_osm_resolution corridor_resolution_confidence text_corridor_norm text_spatial_consistency",
    lambda x: x.events, EVENTS, STR("events_"))
add("event_score", "uuid severity_component:4 mentions_component:6 source_diversity_component:4 impact_social_component:6 geo_quality_component:2 osm_association_component:2 "
    "temporal_recency_component:6 metric_score_0_100:4 metric_category", lambda x: x.events, EVENTS, STR("events_"))

_SQL = {
    "events": "count(*)", "traffic_accidents": "count(*) FILTER (incident = 'TRAFFIC_ACCIDENT')", "mentions": "CAST(sum(mentions) AS BIGINT)",
    "impact_social": "sum(impact_social_score)", "severity_sum": "sum(severity_score)", "valid_points": "count(*) FILTER (coordinate_inside_sv_bbox)",
    "address_events": "count(*) FILTER (has_address)", "avg_metric_score": "avg(metric_score_0_100)", "fatality_events": "count(*) FILTER (fatality_flag)",
    "injury_events": "count(*) FILTER (injury_flag)", "vulnerable_events": "count(*) FILTER (vulnerable_user_flag)",
    "osm_high_medium": "count(*) FILTER (osm_match_status IN ('SPATIAL_OSM_HIGH', 'SPATIAL_OSM_MEDIUM'))",
    "compatible_events": "count(*) FILTER (text_osm_resolution IN ('COMPATIBLE', 'LOCAL_NAME_WITHIN_CORRIDOR', 'INTERSECTION_ACCEPTED'))",
    "review_events": "count(*) FILTER (text_osm_resolution = 'REVIEW_COORDINATE_OR_NAME')",
    "corridor_candidates": "COALESCE(array_to_string(list_sort(list_distinct(list(corridor_candidate) FILTER (corridor_candidate <> ''))), '; '), '')",
    "avg_distance_m": "avg(nearest_osm_distance_m)", "views": "sum(latest_views)", "shares": "sum(latest_shares)",
    "source_diversity_max": "max(source_diversity)", "avg_impact_social": "avg(impact_social_score)", "heavy_vehicle_events": "count(*) FILTER (heavy_vehicle_flag)",
    "repeated_coordinate_events": "count(*) FILTER (repeated_coordinate_flag)", "amss_points": "count(*) FILTER (coordinate_inside_amss_bbox)",
    "avg_osm_distance_m": "avg(nearest_osm_distance_m)", "first_event": "min(event_datetime)", "last_event": "max(event_datetime)",
    "municipalities": "array_to_string(list_sort(list_distinct(list(municipality_norm))), '; ')",
}
_ROUND = ("impact_social", "severity_sum", "avg_metric_score", "avg_distance_m", "views", "shares", "avg_impact_social", "avg_osm_distance_m")


def _spec(names) -> str:
    return " ".join(f"{n}:4" if n in _ROUND else n for n in names)


for _name, (_keys, _measures, _kept) in plan.TABLES.items():
    _where = f"WHERE {_kept} <> ''" if _kept else ""
    _rel = "events_"
    if _name == "territory_normalization":
        _rel = ("(SELECT *, CASE WHEN trim(department) <> '' THEN trim(department) ELSE 'SIN_DEPTO' END AS department_raw, "
                "CASE WHEN trim(municipality) <> '' THEN trim(municipality) ELSE 'SIN_MUNICIPIO' END AS municipality_raw FROM events_)")
    add(f"incident_{_name}", " ".join(_keys) + " " + _spec(_measures), lambda x, n=_name: plan.aggregate(x.events, n),
        f"{EVENTS}, t AS (SELECT {', '.join(_keys)}, {', '.join(f'{_SQL[m]} AS {m}' for m in _measures)} FROM {_rel} {_where} GROUP BY {', '.join(_keys)})", "t")

_W = WEIGHT_PROFILES["ACTUAL_PIPELINE"]
_CRIT = ("events", "mentions", "source_diversity_max", "impact_social", "avg_impact_social", "severity_sum", "fatality_events", "injury_events", "vulnerable_events",
         "heavy_vehicle_events", "repeated_coordinate_events", "amss_points", "osm_high_medium", "avg_osm_distance_m", "municipalities", "compatible_events", "review_events")
CRITICAL = f"""{EVENTS}, c0 AS (SELECT corridor_norm, {', '.join(f'{_SQL[m]} AS {m}' for m in _CRIT)} FROM events_ WHERE corridor_norm <> '' GROUP BY 1),
critical AS (SELECT *, ROUND(100 * {wsum(*[(w, f'(CAST({c} AS DOUBLE)/GREATEST(max({c}) OVER (), 1))') for c, w in _W.items()])}, 2) AS corridor_criticality_score FROM c0)"""
add("critical_corridors", "corridor_norm " + _spec(_CRIT) + " corridor_criticality_score:4", lambda x: plan.critical_corridors(x.events), CRITICAL, "critical")

_p = lambda a, b: f"CASE WHEN {b} = 0 THEN 0e0 ELSE ROUND({a}/CAST({b} AS DOUBLE)*100, 2) END"
_GOOD = "osm_match_status IN ('SPATIAL_OSM_HIGH', 'SPATIAL_OSM_MEDIUM')"
DIAG = f"""{EVENTS}, w AS (SELECT count(*) AS a, count(*) FILTER (corridor_candidate <> '') AS t, count(DISTINCT corridor_candidate) FILTER (corridor_candidate <> '') AS tn_, count(*) FILTER (corridor_norm <> '') AS n,
 count(DISTINCT corridor_norm) FILTER (corridor_norm <> '') AS nn, count(*) FILTER (corridor_candidate <> '' AND coordinate_inside_sv_bbox) AS v, count(*) FILTER (corridor_candidate <> '' AND coordinate_inside_amss_bbox) AS am,
 count(*) FILTER (corridor_candidate <> '' AND {_GOOD}) AS g, sum(CASE WHEN corridor_candidate <> '' THEN impact_social_score ELSE 0 END) AS ti, sum(impact_social_score) AS im FROM events_),
d AS (SELECT 'eventos_con_corredor_textual' AS metric, CAST(t AS DOUBLE) AS value, {_p('t', 'a')} AS percent FROM w UNION ALL SELECT 'corredores_distintos_extraidos', tn_, NULL FROM w
 UNION ALL SELECT 'eventos_con_corredor_norm', n, {_p('n', 'a')} FROM w UNION ALL SELECT 'corredores_norm_distintos', nn, NULL FROM w UNION ALL SELECT 'eventos_con_corredor_y_coordenada_valida', v, {_p('v', 't')} FROM w
 UNION ALL SELECT 'eventos_con_corredor_en_bbox_amss', am, {_p('am', 't')} FROM w UNION ALL SELECT 'eventos_con_corredor_y_osm_alto_medio', g, {_p('g', 't')} FROM w
 UNION ALL SELECT 'impacto_social_en_corredores', ROUND(ti, 4), {_p('ti', 'im')} FROM w)"""
add("corridor_diagnostics", "metric value:4 percent:4", lambda x: plan.corridor_diagnostics(x.events), DIAG, "d")

add("coordinate_table", "coordinate_quality_status events mentions impact_social:4 avg_geo_confidence:6 percent:4", lambda x: plan.coordinate_table(x.events),
    f"""{BASE}, t AS (SELECT coordinate_quality_status, count(*) AS events, CAST(sum(mentions) AS BIGINT) AS mentions, sum(impact_social_score) AS impact_social, avg(geo_confidence) AS avg_geo_confidence,
 ROUND(count(*)/CAST((SELECT count(*) FROM base) AS DOUBLE)*100, 2) AS percent FROM base GROUP BY 1)""", "t")

_INT = {"eventos_totales": "true", "eventos_con_lat_lon": "coordinate_pair_present", "eventos_con_lat_lon_dentro_sv_bbox": "coordinate_inside_sv_bbox",
        "eventos_fuera_sv_bbox": "coordinate_quality_status = 'OUTSIDE_EL_SALVADOR_BBOX'", "eventos_sin_lat_lon": "coordinate_quality_status = 'MISSING_POINT'",
        "eventos_con_coordenada_repetida": "repeated_coordinate_flag", "eventos_con_address": "has_address", "eventos_con_municipio": "has_municipality",
        "eventos_con_departamento": "has_department", "eventos_con_contexto_vial_textual": "road_context_available", "eventos_con_engagement": "engagement_mentions > 0",
        "eventos_con_multiples_menciones": "mentions > 1", "eventos_con_mas_de_una_fuente": "source_diversity > 1", "eventos_con_osm_alto_medio": _GOOD}
_SUM = {"likes_ultimo_snapshot": "latest_likes", "comments_ultimo_snapshot": "latest_comments", "shares_ultimo_snapshot": "latest_shares", "quotes_ultimo_snapshot": "latest_quotes",
        "views_ultimo_snapshot": "latest_views", "impacto_social_ponderado_total": "impact_social_score", "impacto_raw_total": "impact_raw_sum"}
add("integrity", "metric value:4 percent:4", lambda x: plan.integrity(x.events, x.mentions.count(), x.snapshots.count()),
    f"{EVENTS}, i AS (" + " UNION ALL ".join(
        [f"SELECT {q(m)} AS metric, CAST(count(*) FILTER ({c}) AS DOUBLE) AS value, ROUND(count(*) FILTER ({c})/CAST(count(*) AS DOUBLE)*100, 2) AS percent FROM events_" for m, c in _INT.items()]
        + [f"SELECT {q(m)}, ROUND(sum({c}), 4), NULL FROM events_" for m, c in _SUM.items()]
        + ["SELECT 'menciones_expandidas', count(*), NULL FROM (SELECT DISTINCT incident, mention FROM ev)", "SELECT 'snapshots_engagement', count(*), NULL FROM ev"]) + ")", "i")

add("text_conflicts", "uuid corridor_candidate nearest_osm_name:0".replace(":0", "") + " text_spatial_consistency nearest_osm_distance_m:4", lambda x: plan.resolution_conflicts(x.events),
    EVENTS, "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM events_ WHERE text_spatial_consistency = 'TEXT_SPATIAL_CONFLICT')")

add("heat_weights", "uuid event_date event_hour latitude:6 longitude:6 coordinate_quality_status heat_weight_menciones heat_weight_impacto_social:4 heat_weight_eventos metric_category",
    lambda x: plan.heat_weights(x.events), f"{EVENTS}, h AS (SELECT CAST(uuid AS VARCHAR) AS uuid, event_date, event_hour, lat AS latitude, lon AS longitude, coordinate_quality_status, mentions AS heat_weight_menciones, "
    "impact_social_score AS heat_weight_impacto_social, 1 AS heat_weight_eventos, metric_category FROM events_ WHERE coordinate_pair_present)", "h")


# --- nearest road from the road store ------------------------------------------

_MAIN = "(" + ", ".join(q(h) for h in MAJOR_HIGHWAYS) + ")"


def _stored(otherwise: str, rest: str) -> str:
    """Nearest road where departments '0' to '9' have a network of their own, other events the rest's."""
    return f"""{ROADS}, {BASE},
sc AS (SELECT b.*, CASE WHEN len(department_norm) = 1 AND department_norm IN (SELECT source_department FROM seg) THEN 'DEPARTMENT' {otherwise} END AS nearest_osm_source_scope FROM base b),
pr AS (SELECT e.uuid, r.way_id, r.name, r.road_key_norm, {distance('e.lon', 'e.lat')} AS d
   FROM sc e JOIN seg r ON coordinate_inside_sv_bbox AND (nearest_osm_source_scope = 'DEPARTMENT' AND r.source_department = e.department_norm OR {rest})
     AND e.lon BETWEEN LEAST(ax, bx) - 0.035 AND GREATEST(ax, bx) + 0.035 AND e.lat BETWEEN LEAST(ay, by_) - 0.035 AND GREATEST(ay, by_) + 0.035),
nr AS (SELECT uuid, way_id AS nearest_osm_way_id, name AS nearest_osm_name, road_key_norm AS nearest_osm_road_key_norm, ROUND(d, 2) AS nearest_osm_distance_m
   FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY floor(d*1e6+0.5), way_id) rn FROM pr) WHERE rn = 1),
st AS (SELECT sc.*, nr.* EXCLUDE (uuid), CASE nearest_osm_source_scope WHEN 'DEPARTMENT' THEN department_norm WHEN 'NATIONAL' THEN 'NACIONAL' WHEN 'AMSS' THEN 'SAN SALVADOR' ELSE '' END AS nearest_osm_source_department,
   CASE WHEN coordinate_quality_status = 'MISSING_POINT' THEN 'NO_COORDINATE_FOR_OSM' WHEN coordinate_quality_status = 'OUTSIDE_EL_SALVADOR_BBOX' THEN 'INVALID_POINT_FOR_OSM'
   WHEN nearest_osm_source_scope = 'NO_OSM_NETWORK' THEN 'NO_OSM_NETWORK_FOR_POINT' ELSE {ladder('nearest_osm_distance_m', INCIDENT_DISTANCE, INCIDENT_DISTANCE_FAR, 'NO_NEAR_OSM_SEGMENT')} END AS osm_match_status
   FROM sc LEFT JOIN nr USING (uuid))"""


_ROW = "uuid nearest_osm_source_scope nearest_osm_source_department nearest_osm_way_id nearest_osm_name nearest_osm_road_key_norm nearest_osm_distance_m:4 osm_match_status"
add("stored_cascade", _ROW, lambda x: plan.nearest_stored(x.base_events, x.road_store),
    _stored("ELSE 'NATIONAL'", "nearest_osm_source_scope = 'NATIONAL'"), STR("st"))
add("stored_capital", _ROW, lambda x: plan.nearest_stored(x.base_events, x.capital_store),
    _stored("WHEN coordinate_inside_amss_bbox THEN 'AMSS' ELSE 'NO_OSM_NETWORK'", f"nearest_osm_source_scope = 'AMSS' AND r.highway IN {_MAIN}"), STR("st"))
