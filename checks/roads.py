"""Road network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import add
from checks.sql import ROADS, compact, distance, haversine, mode_by, q, utm16
from corridor_spark.fixtures import cte
from corridor_spark.lexicons import ALERT_DISTANCE, ALERT_DISTANCE_FAR, CAPITAL_BOX, MAJOR_HIGHWAYS
from corridor_spark.operators.nearest import SPHERE, nearest, nearest_of_key
from corridor_spark.plans import alerts as alert_plan
from corridor_spark.functions.numbers import distance_class
from corridor_spark.sources import road_store, roads

MAJOR = "(" + ", ".join(q(h) for h in MAJOR_HIGHWAYS) + ")"

add("road_segments", "osm_way_id length_m:4 vertices name_norm ref_norm road_key_norm road_type_category source_department", lambda x: x.segments,
    f"{ROADS}, s AS (SELECT *, way_id AS osm_way_id, 2 AS vertices, {compact('name')} AS name_norm, {compact('ref')} AS ref_norm FROM seg)", "s")

add("road_catalog", "source_department road_key_norm segment_count length_km:4 representative_name predominant_highway predominant_road_type refs names osm_way_ids highway_values",
    lambda x: roads.with_way_ids(x.catalog, x.segments), f"""{ROADS}, rc AS (SELECT c.*, COALESCE(array_to_string(ref_list, '; '), '') AS refs, l.names, l.osm_way_ids, l.highway_values FROM cat c
 JOIN (SELECT source_department, road_key_norm, COALESCE(array_to_string(list_sort(list_distinct(list(name) FILTER (name <> ''))), '; '), '') AS names,
  array_to_string(list_sort(list(way_id)), ';') AS osm_way_ids, array_to_string(list_sort(list_distinct(list(highway))), '; ') AS highway_values FROM seg GROUP BY 1, 2) l USING (source_department, road_key_norm))""", "rc")

add("area_catalog", "road_key_norm segment_count length_km:4 representative_name search_text", lambda x: roads.road_catalog(roads.area_segments(x.segments.select("osm_way_id", "name", "ref", "highway", "coords")), False),
    f"""{ROADS}, ar AS (SELECT road_key_norm, count(*) AS segment_count, ROUND(sum(length_m)/1000, 3) AS length_km, COALESCE(array_to_string(list_sort(list_distinct(list(ref) FILTER (ref <> ''))), '; '), '') AS refs,
 COALESCE(array_to_string(list_sort(list_distinct(list(name) FILTER (name <> ''))), '; '), '') AS names FROM seg GROUP BY 1),
a2 AS (SELECT a.*, COALESCE(n.name, '') AS representative_name, {compact("concat_ws(' ', road_key_norm, COALESCE(n.name, ''), names, refs)")} AS search_text FROM ar a LEFT JOIN {mode_by('seg', 'road_key_norm', 'name')} n USING (road_key_norm))""", "a2")

add("network_summary", "highway segmentos km:4 vias_con_nombre vias_oneway", lambda x: roads.network_summary(x.segments),
    f"{ROADS}, n AS (SELECT highway, count(*) AS segmentos, sum(length_m)/1000 AS km, count(*) FILTER (name <> '') AS vias_con_nombre, 0 AS vias_oneway FROM seg GROUP BY 1)", "n")
add("network_coverage", "source_department segments catalog_roads length_km:4 status", lambda x: roads.network_coverage(x.segments),
    f"{ROADS}, n AS (SELECT source_department, count(*) AS segments, count(DISTINCT road_key_norm) AS catalog_roads, ROUND(sum(length_m)/1000, 3) AS length_km, 'OK' AS status FROM seg GROUP BY 1)", "n")


def _national(x):
    shared = x.segments.withColumn("source_department", F.lit("zz shared"))
    return roads.national([x.segments, shared]).groupBy("source_department").agg(F.count(F.lit(1)).alias("segments"))


add("national_dedup", "source_department segments", _national,
    f"{ROADS}, n AS (SELECT source_department, count(*) AS segments FROM (SELECT way_id, min(source_department) AS source_department FROM (SELECT way_id, source_department FROM seg UNION ALL SELECT way_id, 'zz shared' FROM seg) GROUP BY 1) GROUP BY 1)", "n")
add("department_segments", "osm_way_id highway source_department length_km:6", lambda x: roads.load_segments(x.segments, ["3", "5"], True),
    f"{ROADS}, n AS (SELECT way_id AS osm_way_id, highway, source_department, length_m/1000 AS length_km FROM seg WHERE source_department IN ('3', '5') AND highway IN {MAJOR})", "n")
add("segments_by_key", "osm_way_id road_key_norm", lambda x: roads.segments_by_key(x.segments, x.catalog.filter("segment_count > 1").select(F.col("road_key_norm").alias("corridor_key"))),
    f"{ROADS}, n AS (SELECT way_id AS osm_way_id, road_key_norm FROM seg WHERE highway IN {MAJOR} AND road_key_norm IN (SELECT road_key_norm FROM cat WHERE segment_count > 1))", "n")
add("named_segments", "osm_way_id name ref", lambda x: roads.named_segments(x.segments), f"{ROADS}", "(SELECT way_id AS osm_way_id, name, ref FROM seg WHERE name <> '' OR ref <> '')")
add("longest_in_box", "osm_way_id length_m:4", lambda x: roads.longest_in_box(x.segments, CAPITAL_BOX, 200), f"""{ROADS},
l AS (SELECT way_id AS osm_way_id, * FROM seg WHERE highway IN {MAJOR} ORDER BY length_m DESC, way_id LIMIT 200),
l2 AS (SELECT * FROM l WHERE GREATEST(ax, bx) >= -89.42 AND LEAST(ax, bx) <= -89.00 AND GREATEST(ay, by_) >= 13.55 AND LEAST(ay, by_) <= 13.92)""", "l2")
add("road_keys", "key", lambda x: roads.road_keys(x.catalog, False), f"""{ROADS}, k AS (SELECT DISTINCT key FROM (SELECT {compact('p')} AS key FROM
 (SELECT unnest(list_concat([road_key_norm, representative_name], ref_list)) AS p FROM cat) UNION ALL SELECT {compact('name')} FROM seg) WHERE key <> '' AND NOT starts_with(key, 'osm way'))""", "k")


def _by_key(x):
    points = x.prepared_alerts.filter("has_valid_coordinate").select(F.col("uuid").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"),
                                                                     F.col("street_norm").alias("road_key_norm"))
    return nearest_of_key(points, x.point_pieces, "road_key_norm", ["way_id", "highway"])


add("nearest_by_key", "point_id way_id highway distance_m:4", _by_key, f"""{ROADS}, {cte('alert')},
p AS (SELECT a.uuid AS point_id, way_id, highway, {distance('a.lon', 'a.lat')} AS distance_m FROM alert a JOIN seg r ON r.road_key_norm = regexp_replace(lower(street), '^av\\.', 'avenida')
 WHERE lat BETWEEN 13.0 AND 14.7 AND lon BETWEEN -90.4 AND -87.5),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY floor(distance_m*1e6+0.5), way_id) rn FROM p) WHERE rn = 1)""", "b")


def _foot(x):
    points = x.prepared_alerts.filter("has_valid_coordinate").select(F.col("uuid").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    hit = nearest(points, x.point_pieces, (200.0, 1000.0, 5000.0), ["way_id"], SPHERE, foot=True, beyond=True)
    return hit.select("point_id", "way_id", "distance_m", F.col("foot.x").alias("foot_lon"), F.col("foot.y").alias("foot_lat"),
                      distance_class(F.col("distance_m"), ((30, "HIGH"), (50, "MEDIUM"), (100, "LOW")), "REVIEW", "NO_MATCH").alias("quality"))


_K = "(6371000e0*pi()/180)"
_d = distance("a.lon", "a.lat", f"({_K}*cos(radians(a.lat)))", _K)
_t = _d[_d.index("(CASE WHEN"):_d.index("ELSE 0e0 END)") + len("ELSE 0e0 END)")]
add("nearest_foot_point", "point_id way_id distance_m:4 foot_lon:7 foot_lat:7 quality", _foot, f"""{ROADS}, {cte('alert')},
p AS (SELECT a.uuid AS point_id, way_id, {_d} AS distance_m, ax + {_t}*(bx-ax) AS foot_lon, ay + {_t}*(by_-ay) AS foot_lat FROM alert a JOIN seg r ON lat BETWEEN 13.0 AND 14.7 AND lon BETWEEN -90.4 AND -87.5),
b AS (SELECT *, CASE WHEN distance_m <= 30 THEN 'HIGH' WHEN distance_m <= 50 THEN 'MEDIUM' WHEN distance_m <= 100 THEN 'LOW' ELSE 'REVIEW' END AS quality
 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY floor(distance_m*1e6+0.5), way_id) rn FROM p) WHERE rn = 1)""", "b")

_PX, _PY = utm16("lon", "lat")
(_AX, _AY), (_BX, _BY) = utm16("ax", "ay"), utm16("bx", "by_")
add("nearest_projected", "uuid nearest_way_id nearest_osm_distance_m:4 osm_match_status",
    lambda x: alert_plan.nearest_roads(x.prepared_alerts, alert_plan.projected_pieces(x.pieces)).withColumn(
        "osm_match_status", alert_plan.match_status(F.col("nearest_osm_distance_m"))), f"""{ROADS}, {cte('alert')},
u AS (SELECT way_id, {_AX} AS ax, {_AY} AS ay, {_BX} AS bx, {_BY} AS by_ FROM seg WHERE ax <> bx OR ay <> by_),
v AS (SELECT uuid, {_PX} AS px, {_PY} AS py, COALESCE(lat BETWEEN 13.0 AND 14.7 AND lon BETWEEN -90.4 AND -87.5, false) AS ok FROM alert),
p AS (SELECT uuid, way_id, {distance('px', 'py', '1e0', '1e0')} AS d FROM v JOIN u ON ok),
b AS (SELECT uuid, way_id, ROUND(d, 3) AS d FROM (SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY floor(d*1e6+0.5), way_id) rn FROM p) WHERE rn = 1),
r AS (SELECT v.uuid, way_id AS nearest_way_id, d AS nearest_osm_distance_m, CASE WHEN d IS NULL THEN 'NO_COORDINATE_FOR_OSM'
  {' '.join(f"WHEN d <= {limit} THEN {q(name)}" for limit, name in ALERT_DISTANCE)} ELSE {q(ALERT_DISTANCE_FAR)} END AS osm_match_status FROM v LEFT JOIN b USING (uuid))""", "r")

add("way_lengths", "way_id length_m:4", lambda x: roads.way_lengths(x.point_pieces), f"{cte('road_piece')}, w AS (SELECT way_id, {haversine('ax', 'ay', 'bx', 'by_')} AS length_m FROM road_piece)", "w")


# --- selections from the road store ---------------------------------------------

_SEL = "osm_way_id highway source_department length_km:6"
_LENGTH = "SELECT way_id AS osm_way_id, highway, source_department, length_m/1000 AS length_km FROM seg WHERE highway IN"
add("stored_departments", _SEL, lambda x: road_store.select_segments(x.road_store, ["3", "5", "12"]),
    f"{ROADS}, n AS ({_LENGTH} {MAJOR} AND source_department IN ('3', '5'))", "n")
add("stored_national", _SEL, lambda x: road_store.select_segments(x.road_store, ["11", "12"]), f"{ROADS}, n AS ({_LENGTH} {MAJOR})", "n")
add("stored_roads", "osm_way_id road_key_norm", lambda x: road_store.stored_roads(x.road_store, x.catalog.filter("segment_count > 1").select(F.col("road_key_norm").alias("corridor_key"))),
    f"{ROADS}, n AS (SELECT way_id AS osm_way_id, road_key_norm FROM seg WHERE highway IN {MAJOR} AND road_key_norm IN (SELECT road_key_norm FROM cat WHERE segment_count > 1))", "n")
