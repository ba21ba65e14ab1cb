"""Interactive and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.alerts import ALERTS
from checks.incidents import CRITICAL, EVENTS
from checks.integration import BOTH, SUMMARY
from checks.registry import add
from checks.sql import ROADS, distance, scale, tcompact
from corridor_spark.lexicons import ALERT_TYPE_LABELS
from corridor_spark.operators.cell_index import write_cells
from corridor_spark.plans import interactive as plan
from corridor_spark.fixtures import cte
from corridor_spark.session import stage, stage_root
from corridor_spark.sources import incidents as incident_source
from corridor_spark.streaming import windows

DAY, NOW = "2024-01-10", 900
STR = "(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM {})".format
_FACETS = plan.Facets(start="2024-01-03", end="2024-01-20", hours=(5, 20), values={
    "municipality_norm": ("SIN_MUNICIPIO", "Ilopango", "Santa Tecla"), "incident": ("TRAFFIC_ACCIDENT", "OTHER")})
_WHERE = ("event_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' AND event_hour BETWEEN 5 AND 20 AND municipality_norm IN ('SIN_MUNICIPIO', 'Ilopango', 'Santa Tecla') "
          "AND incident IN ('TRAFFIC_ACCIDENT', 'OTHER')")
add("facet_filter", "uuid event_date event_hour municipality_norm incident", lambda x: plan.filter_events(x.events, _FACETS), EVENTS, f"(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM events_ WHERE {_WHERE})")
add("typed_events", "uuid heat_weight_menciones:2 heat_weight_impacto_social:4 coordinate_pair_present", lambda x: incident_source.load_events(x.events.withColumn("event_datetime", F.col("event_datetime"))), EVENTS,
    "(SELECT CAST(uuid AS VARCHAR) AS uuid, mentions AS heat_weight_menciones, impact_social_score AS heat_weight_impacto_social, coordinate_pair_present FROM events_)")

_ROLL = {"date": "event_date", "hour": "event_hour", "department": "department_norm", "municipality": "department_norm, municipality_norm", "source": "source", "corridor": "corridor_norm"}
_SQL = {"events": "count(*)", "mentions": "CAST(sum(mentions) AS BIGINT)", "views": "sum(latest_views)", "shares": "sum(latest_shares)", "likes": "sum(latest_likes)", "impact_social": "sum(impact_social_score)",
        "avg_metric": "avg(metric_score_0_100)", "severity_sum": "sum(severity_score)", "fatality_events": "count(*) FILTER (fatality_flag)", "injury_events": "count(*) FILTER (injury_flag)",
        "vulnerable_events": "count(*) FILTER (vulnerable_user_flag)", "osm_high_medium": "count(*) FILTER (osm_match_status IN ('SPATIAL_OSM_HIGH', 'SPATIAL_OSM_MEDIUM'))",
        "review_events": "count(*) FILTER (text_osm_resolution = 'REVIEW_COORDINATE_OR_NAME')", "unresolved_events": "count(*) FILTER (text_osm_resolution = 'UNRESOLVED')", "avg_distance_m": "avg(nearest_osm_distance_m)"}
for _n, (_k, _m) in plan.ROLLUPS.items():
    _spec = " ".join(_k) + " " + " ".join(f"{m}:4" if m in ("views", "shares", "likes", "impact_social", "avg_metric", "severity_sum", "avg_distance_m") else m for m in _m)
    add(f"rollup_{_n}", _spec, lambda x, n=_n: plan.rollup(plan.filter_events(x.events, _FACETS), n),
        f"{EVENTS}, r AS (SELECT {_ROLL[_n]}, {', '.join(f'{_SQL[m]} AS {m}' for m in _m)} FROM events_ WHERE {_WHERE} {'AND corridor_norm <> ' + repr('') if _n == 'corridor' else ''} GROUP BY {_ROLL[_n]})", "r")
add("corridor_criticality", "corridor_norm events corridor_criticality_score:4", lambda x: plan.corridor_criticality(plan.rollup(x.events, "corridor"), x.critical), CRITICAL, "critical")

_g = "osm_match_status IN ('SPATIAL_OSM_HIGH', 'SPATIAL_OSM_MEDIUM')"
_C = {"osm_alto_medio": _g, "sin_coordenada_osm": "osm_match_status = 'NO_COORDINATE_FOR_OSM'", "con_corredor": "corridor_norm <> ''", "sin_resolver": "text_osm_resolution = 'UNRESOLVED'",
      "severos": "severity_class IN ('FATALITY_REPORTED', 'INJURY_REPORTED')", "coordenadas_validas": "coordinate_inside_sv_bbox", "coordenadas_repetidas": "repeated_coordinate_flag", "sin_coordenada": "coordinate_quality_status = 'MISSING_POINT'"}
add("filtered_counters", "metric value:4 percent:4", lambda x: plan.counters(x.events), f"{EVENTS}, c AS (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS metric, CAST(count(*) FILTER ({c}) AS DOUBLE) AS value, ROUND(count(*) FILTER ({c})/CAST(count(*) AS DOUBLE)*100, 2) AS percent FROM events_" for n, c in _C.items()]
    + [f"SELECT 'distancia_media', ROUND(avg(nearest_osm_distance_m) FILTER ({_g}), 4), NULL FROM events_", "SELECT 'tipos_de_via', count(DISTINCT nearest_osm_road_type), NULL FROM events_"]) + ")", "c")

_heat = lambda x: plan.heat_cells(x.events.filter("coordinate_inside_sv_bbox"), "impact_social_score", 0.02)
HEAT = f"""{EVENTS}, h AS (SELECT CAST(floor(lon/0.02) AS BIGINT) AS cell_lon, CAST(floor(lat/0.02) AS BIGINT) AS cell_lat, sum(impact_social_score) AS heat FROM events_ WHERE coordinate_inside_sv_bbox AND impact_social_score > 0 GROUP BY 1, 2)"""
add("heat_cells", "cell_lon cell_lat heat:4", _heat, HEAT, "h")
add("heat_breaks", "q0:4 q25:4 q50:4 q75:4 q100:4 total:4 largest:4 cells", lambda x: plan.heat_breaks(_heat(x)),
    f"{HEAT}, b AS (SELECT {', '.join(f'quantile_cont(heat, {v}) AS q{int(v * 100)}' for v in (0, .25, .5, .75, 1))}, sum(heat) AS total, max(heat) AS largest, count(*) AS cells FROM h)", "b")
add("heat_points", "lon:6 lat:6 heat_weight:4", lambda x: plan.heat_points(x.alerts, x.events), f"{BOTH}, {EVENTS[EVENTS.index('snapshot AS ('):]}, "
    "hp AS (SELECT lon, lat, GREATEST(alert_impact_score, 1) AS heat_weight FROM alerts WHERE lon IS NOT NULL AND lat IS NOT NULL UNION ALL "
    "SELECT lon, lat, GREATEST(CASE WHEN impact_social_score > 0 THEN impact_social_score ELSE mentions END, 1) FROM events_ WHERE lon IS NOT NULL AND lat IS NOT NULL)", "hp")
add("alert_window_groups", "alert_group alerts reports impact:4 critical", lambda x: plan.alert_window_groups(x.alerts),
    f"{ALERTS}, g AS (SELECT alert_group, count(*) AS alerts, CAST(sum(cluster_report_count) AS BIGINT) AS reports, sum(alert_impact_score) AS impact, count(*) FILTER (is_critical_alert) AS critical FROM alerts GROUP BY 1)", "g")
add("readable_counts", "categoria eventos", lambda x: plan.readable_counts(x.view("alert"), "type", ALERT_TYPE_LABELS),
    "a AS (SELECT CASE event_id % 4 WHEN 0 THEN 'Accidente' WHEN 1 THEN 'Cierre vial' WHEN 2 THEN 'Congestion reportada' ELSE 'Peligro vial' END AS categoria, count(*) AS eventos FROM events GROUP BY 1)", "a")

_lt = "(ts - INTERVAL 6 HOURS)"


def _ranking_sql(lo: int, hi: int) -> str:
    minute = lambda t: f"hour({t})*60 + minute({t})"
    return f"""{BOTH}, {EVENTS[EVENTS.index('snapshot AS ('):]},
wj0 AS (SELECT {tcompact('corridor_norm')} AS k, corridor_norm, delay_mean, congestion_load, jam_intensity_score FROM jams WHERE CAST(ts_first - INTERVAL 6 HOURS AS DATE) = DATE '{DAY}' AND {minute('(ts_first - INTERVAL 6 HOURS)')} BETWEEN {lo} AND {hi}),
wj1 AS (SELECT k, min(corridor_norm) AS nm, CAST(count(*) AS DOUBLE) AS visible_jams, sum(delay_mean/60) AS visible_delay_min, sum(congestion_load) AS visible_congestion_load, avg(jam_intensity_score) AS vi FROM wj0 WHERE k NOT IN ('', 'unresolved') GROUP BY 1),
wj AS (SELECT *, ROUND(100*(0.3e0*{scale('visible_jams')} + 0.3e0*{scale('visible_delay_min')} + 0.25e0*{scale('visible_congestion_load')} + 0.15e0*{scale('vi')}), 3) AS temporal_jam_pressure FROM wj1),
wj90 AS (SELECT * FROM wj ORDER BY temporal_jam_pressure DESC, k LIMIT 90),
wu AS (SELECT k, visible_jams, temporal_jam_pressure AS tp, 0e0 AS va, 0e0 AS ai, 0e0 AS vn, 0e0 AS ni FROM wj90
 UNION ALL SELECT {tcompact('corridor_norm_alert')}, 0, 0, 1, alert_impact_score, 0, 0 FROM alerts WHERE CAST({_lt} AS DATE) = DATE '{DAY}' AND {minute(_lt)} BETWEEN {lo} AND {hi} AND {tcompact('corridor_norm_alert')} <> ''
 UNION ALL SELECT {tcompact('corridor_norm')}, 0, 0, 0, 0, 1, impact_social_score FROM events_ WHERE event_date = DATE '{DAY}' AND {minute('event_datetime')} BETWEEN {lo} AND {hi} AND {tcompact('corridor_norm')} <> ''),
wg AS (SELECT k AS corridor_norm_key, sum(visible_jams) AS visible_jams, sum(tp) AS temporal_jam_pressure, sum(va) AS visible_alerts, sum(ai) AS alert_impact, sum(vn) AS visible_news, sum(ni) AS news_impact FROM wu GROUP BY 1),
wr AS (SELECT *, ROUND(100*(0.45e0*{scale('temporal_jam_pressure')} + 0.35e0*{scale('alert_impact')} + 0.2e0*{scale('news_impact')}), 3) AS dynamic_corridor_pressure FROM wg)"""


_RANK = "corridor_norm_key visible_jams:2 temporal_jam_pressure:4 visible_alerts:2 alert_impact:4 visible_news:2 news_impact:4 dynamic_corridor_pressure:4"
for _name, _mode in (("window_ranking", "moving"), ("accumulated", "accumulated"), ("new_events", "new")):
    add(_name, _RANK, lambda x, m=_mode: plan.window_ranking(x.jams, x.alerts, x.events, DAY, NOW, m), _ranking_sql(*plan.window_bounds(NOW, _mode)), "wr")

add("frames", "frame_end alerts impact:4 trail_alerts", lambda x: plan.frames(x.alerts), f"""{ALERTS},
f0 AS (SELECT time_bucket(INTERVAL 15 MINUTES, {_lt}) + INTERVAL 15 MINUTES AS e, alert_impact_score FROM alerts),
f1 AS (SELECT e AS frame_end, count(*) AS alerts, sum(alert_impact_score) AS impact FROM f0 GROUP BY 1),
f2 AS (SELECT e + INTERVAL 15 MINUTES * i AS frame_end, count(*) AS trail_alerts FROM f0, range(4) t(i) GROUP BY 1),
f3 AS (SELECT frame_end, COALESCE(alerts, 0) AS alerts, COALESCE(impact, 0) AS impact, trail_alerts FROM f2 LEFT JOIN f1 USING (frame_end))""", "f3")
add("detail_rows", "fuente uuid minute_label osm_match_status", lambda x: plan.detail_rows(*[plan.day_rows(x.jams, x.alerts, x.events, DAY)[k] for k in ("alerts", "news")]),
    f"""{BOTH}, {EVENTS[EVENTS.index('snapshot AS ('):]}, dr0 AS (
 SELECT 'Waze Alert' AS fuente, CAST(uuid AS VARCHAR) AS uuid, {_lt} AS t, osm_match_status FROM alerts WHERE CAST({_lt} AS DATE) = DATE '{DAY}'
 UNION ALL SELECT 'Noticia/incidente', CAST(uuid AS VARCHAR), event_datetime, osm_match_status FROM events_ WHERE event_date = DATE '{DAY}'),
dr AS (SELECT fuente, uuid, strftime(t, '%H:%M') AS minute_label, osm_match_status FROM dr0)""", "dr")
add("top_segments", "osm_way_id road_key_norm integrated_corridor_pressure:4", lambda x: plan.top_segments(x.segments, x.integrated, "corridor_key", "integrated_corridor_pressure", 90, 0.5), f"""{SUMMARY},
ts0 AS (SELECT corridor_key, integrated_corridor_pressure FROM integrated WHERE integrated_corridor_pressure >= (SELECT quantile_cont(integrated_corridor_pressure, .5) FROM integrated) ORDER BY 2 DESC, 1 LIMIT 90),
ts1 AS (SELECT way_id AS osm_way_id, road_key_norm, integrated_corridor_pressure FROM seg JOIN ts0 ON corridor_key = road_key_norm)""", "ts1")

for _n, _w in (("outside", "coordinate_quality_status = 'OUTSIDE_EL_SALVADOR_BBOX'"), ("repeated", "repeated_coordinate_flag"), ("missing", "coordinate_quality_status = 'MISSING_POINT'")):
    add(f"review_{_n}", "uuid coordinate_quality_status coordinate_key_6dec impact_social_score:4", lambda x, n=_n: plan.review_extracts(x.events)[n], EVENTS,
        f"(SELECT * REPLACE (CAST(uuid AS VARCHAR) AS uuid) FROM events_ WHERE {_w})")
add("label_segments", "label road_key_norm osm_way_id", lambda x: plan.label_segments(x.segments, x.text_matches))

# --- streams over the events table -------------------------------------------


def _events_stream(x):
    batch = x.table("events")
    return windows.read_stream(x.spark, f"{x.sf_dir}/events.parquet*", batch.schema)


def _drained(x, df, key="window_end"):
    return windows.drain(df, f"{stage_root(x.spark)}/stream-{uuid.uuid4().hex}", [key, *[c for c in df.columns if c in ("window_start", "event_type", "corridor_key")]])


_END = lambda df: df.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))
add("moving_window", "window_end event_type n total:4", lambda x: _END(_drained(x, windows.sliding(_events_stream(x), "event_type", "value", "60 minutes", "15 minutes"))),
    "m AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES * (i + 1) AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events, range(4) t(i) GROUP BY 1, 2)", "m")
add("stream_frames", "window_end event_type n total:4", lambda x: _END(_drained(x, windows.tumbling(_events_stream(x), "event_type", "value"))),
    "m AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)", "m")
add("stream_days", "day event_type n total:4", lambda x: _drained(x, windows.accumulated(_events_stream(x), "event_type", "value"), "day"),
    "m AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2)", "m")


def _newest(x, keys, columns):
    frames = windows.drain(windows.latest_snapshots(_events_stream(x), keys, columns), f"{stage_root(x.spark)}/stream-{uuid.uuid4().hex}", [*keys, "frame"])
    return windows.newest_of(frames, keys, columns)


add("stream_snapshots", "user_id event_type value:4 snapshots", lambda x: _newest(x, ["user_id", "event_type"], ["event_id", "value"]),
    "m AS (SELECT user_id, event_type, arg_max(value, (ts, event_id, value)) AS value, count(*) AS snapshots FROM events GROUP BY 1, 2)", "m")


def _jam_stream(x):
    """The jam view over the event stream."""
    source = x.view("jam_obs")
    stream = windows.read_stream(x.spark, f"{x.sf_dir}/events.parquet*", x.table("events").schema)
    return stream.select(F.floor(F.col("event_id") / 4).alias("uuid"), F.col("event_id").alias("id"), "ts", ((F.col("event_id") * 31) % 5 + 1).cast("int").alias("level"),
                         (F.col("value") * 20.0).alias("delay"), ((F.col("event_id") * 37) % 4000 + 50.0).alias("length"),
                         ((F.col("event_id") * 17) % 45).cast("double").alias("speedkmh")).select(*[c for c in source.columns if c not in ("street", "city")])


add("stream_jams", "uuid level_max level_mean:4 delay_max:4 delay_mean:4 length_max:4 speed_min:4 speed_mean:4 records_per_uuid",
    lambda x: windows.jam_measures(windows.drain(windows.running_jams(_jam_stream(x)), f"{stage_root(x.spark)}/stream-{uuid.uuid4().hex}", ["uuid", "frame"])),
    f"""{cte('jam_obs')}, m AS (SELECT uuid, max(level) AS level_max, avg(level) AS level_mean, max(delay) AS delay_max, avg(delay) AS delay_mean, max(length) AS length_max,
    min(speedkmh) AS speed_min, avg(speedkmh) AS speed_mean, count(*) AS records_per_uuid FROM jam_obs GROUP BY 1)""", "m")


def _ranked(x):
    events, kind = _events_stream(x), F.col("event_type")
    rows = events.select("ts", F.when(kind.isin("click", "view"), "jam").when(kind == "error", "alert").otherwise("news").alias("source"),
                         F.concat(F.lit("corredor "), (F.col("user_id") % 40).cast("string")).alias("corridor_key"), (F.col("value") / 60).alias("delay_min"),
                         (F.col("value") * (F.col("event_id") % 5)).alias("congestion_load"), (F.col("event_id") % 100).cast("double").alias("jam_intensity"),
                         F.col("value").alias("impact"))
    return _END(windows.rank_windows(stage(_drained(x, windows.source_totals(rows)), "window-totals")))


def _in_window(x: str) -> str:
    top = f"quantile_cont(GREATEST({x}, 0), .95) OVER (PARTITION BY window_end)"
    high = f"(CASE WHEN {top} > 0 THEN {top} ELSE max({x}) OVER (PARTITION BY window_end) END)"
    return f"(CASE WHEN {high} > 0 THEN LEAST(GREATEST({x}, 0)/{high}, 1) ELSE 0 END)"


add("stream_ranking", "window_end corridor_key visible_jams temporal_jam_pressure:4 alert_impact:4 news_impact:4 dynamic_corridor_pressure:4", _ranked, f"""
e AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES * (i + 1) AS window_end, 'corredor ' || (user_id % 40) AS corridor_key, event_type IN ('click', 'view') AS jam,
  event_type = 'error' AS alert, value, event_id FROM events, range(4) t(i)),
t AS (SELECT window_end, corridor_key, count(*) FILTER (jam) AS n, COALESCE(sum(value/60) FILTER (jam), 0) AS d, COALESCE(sum(value*(event_id % 5)) FILTER (jam), 0) AS l,
  COALESCE(avg(CAST(event_id % 100 AS DOUBLE)) FILTER (jam), 0) AS v, COALESCE(sum(value) FILTER (alert), 0) AS a, COALESCE(sum(value) FILTER (NOT jam AND NOT alert), 0) AS w FROM e GROUP BY 1, 2),
j AS (SELECT *, ROUND(100*(0.3e0*{_in_window('n')} + 0.3e0*{_in_window('d')} + 0.25e0*{_in_window('l')} + 0.15e0*{_in_window('v')}), 3) AS p FROM t WHERE n > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY window_end ORDER BY p DESC, corridor_key) <= 90 AS top FROM j UNION ALL SELECT *, 0, false FROM t WHERE n = 0),
r AS (SELECT window_end, corridor_key, CASE WHEN top THEN n ELSE 0 END AS visible_jams, CASE WHEN top THEN p ELSE 0 END AS temporal_jam_pressure, a AS alert_impact, w AS news_impact
  FROM k WHERE top OR a <> 0 OR w <> 0),
s AS (SELECT *, ROUND(100*(0.45e0*{_in_window('temporal_jam_pressure')} + 0.35e0*{_in_window('alert_impact')} + 0.2e0*{_in_window('news_impact')}), 3) AS dynamic_corridor_pressure FROM r)""", "s")


# --- nearest road in flight, against cells written once --------------------------

_LON = "CASE WHEN event_id % 9 <> 0 THEN -89.42e0 + CAST((event_id*7919) % 2600 AS DOUBLE)/10000e0 END"
_LAT = "CASE WHEN event_id % 101 = 5 THEN 40e0 ELSE 13.55e0 + CAST((event_id*104729) % 1600 AS DOUBLE)/10000e0 END"


def _in_flight(x):
    folder = f"{stage_root(x.spark)}/flight-{uuid.uuid4().hex}"
    index = write_cells(x.point_pieces, f"{folder}/index", (200.0, 2000.0), ["way_id", "highway"])
    alerts = _events_stream(x).select(F.col("event_id").alias("point_id"), F.expr(_LON).alias("x"), F.expr(_LAT).alias("y"))
    windows.each_batch(alerts, windows.nearest_in_batch(index, f"{folder}/out", ["way_id", "highway"]), f"{folder}/state", "append").awaitTermination()
    return x.spark.read.parquet(f"{folder}/out")


add("stream_nearest", "point_id way_id highway distance_m:4", _in_flight, f"""{ROADS},
p AS (SELECT event_id AS point_id, {_LON} AS lon, {_LAT} AS lat FROM events),
m AS (SELECT point_id, way_id, highway, {distance('p.lon', 'p.lat')} AS distance_m FROM p JOIN seg ON p.lon BETWEEN LEAST(ax, bx) - 0.02 AND GREATEST(ax, bx) + 0.02 AND p.lat BETWEEN LEAST(ay, by_) - 0.02 AND GREATEST(ay, by_) + 0.02),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY floor(distance_m*1e6+0.5), way_id) rn FROM m WHERE distance_m <= 2000) WHERE rn = 1)""", "n")
