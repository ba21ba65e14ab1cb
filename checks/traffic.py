"""Jam queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import add
from checks.sql import (
    ALIASES, JAM_PANEL, JAM_SUMMARY, JAMS, ROADS, UNIQUE, compact, norm, plain, refs, resolve, road, scale, tcompact, title,
    ttext, words,
)
from corridor_spark.fixtures import cte
from corridor_spark.operators import norms
from corridor_spark.operators.contains import best_contained
from corridor_spark.operators.tables import top_rows
from corridor_spark.plans import jams as jam_plan
from corridor_spark.plans.resolve import resolve_texts
from corridor_spark.functions import refs as ref_fn
from corridor_spark.sources.sinks import jam_layers
from corridor_spark.functions import text as text_fn

add("unique_jams",
    "uuid id event_hour street_modal city_modal level_max:4 level_median:4 level_mean:4 level_range:4 delay_max:4 "
    "delay_median:4 delay_mean:4 delay_std:4 delay_range:4 length_max:4 length_median:4 length_mean:4 length_std:4 "
    "length_range:4 speed_min:4 speed_median:4 speed_mean:4 speed_std:4 speed_range:4 records_per_uuid",
    lambda x: x.unique_jams, UNIQUE, "jam1")

add("jam_texts", "uuid street_norm city_norm route_ref road_name_candidate road_text_combined has_street has_route_ref",
    lambda x: x.unique_jams, UNIQUE + f""",
tx AS (SELECT uuid, street_modal AS street, city_modal, {ttext('street_modal')} AS t FROM jam1),
pp AS (SELECT *, list_filter(list_transform(string_split(t, '/'), lambda x: {words(plain('x'))}), lambda x: x <> '') AS parts,
       {words(plain('t'))} AS street_norm, array_to_string({refs('t')}, ';') AS route_ref FROM tx),
qq AS (SELECT *, CASE WHEN len(parts) >= 2 THEN COALESCE(list_filter(parts, lambda x: len({refs('x')}) = 0)[1], parts[-1]) ELSE '' END AS aft FROM pp),
res AS (SELECT uuid, street_norm, {tcompact('city_modal')} AS city_norm, route_ref, {title('aft')} AS road_name_candidate,
        street_norm AS road_text_combined, street_norm <> '' AS has_street, route_ref <> '' AS has_route_ref FROM qq)""", "res")

add("jam_metrics",
    "uuid corridor_norm corridor_match_method corridor_match_confidence delay_min:4 length_km:4 congestion_load:4 delay_density:4 "
    "speed_category speed_collapse_flag severe_jam_flag extreme_jam_flag jam_intensity_score:3 jam_estimation_stability:3 "
    "jam_estimation_stability_class congestion_reliability_proxy:3",
    lambda x: x.jams, JAMS, "jams")

add("resolve_traffic",
    "uuid street_modal corridor_candidate corridor_norm corridor_local_name corridor_group corridor_match_method "
    "corridor_match_confidence corridor_match_status corridor_resolution_detail corridor_norm_group",
    lambda x: x.resolved_jams, JAMS, "jam2")

add("jam_panel",
    "corridor_norm event_hour jams_count records_count delay_total_min:3 delay_avg_min:3 length_total_km:3 length_avg_km:3 "
    "avg_speed_kmh:3 min_speed_kmh:3 level_avg:3 level_max:3 severe_jam_count extreme_jam_count speed_collapse_count "
    "congestion_load_total:3 delay_density_avg:3 jam_intensity_total:2 jam_intensity_avg:2 estimation_stability_avg:3 "
    "high_confidence_jams medium_confidence_jams low_confidence_jams unresolved_jams",
    lambda x: x.jam_panel, JAM_PANEL, "jam_panel")

add("jam_summary",
    "corridor_norm jams_count_total records_count_total active_congestion_hours corridor_delay_burden:2 corridor_length_burden:2 "
    "corridor_congestion_load:2 corridor_avg_speed:3 corridor_min_speed:3 severe_jam_count_total speed_collapse_count_total "
    "jam_intensity_total:2 estimation_stability_avg:3 peak_congestion_hour peak_hour_intensity:2 congestion_volatility:2 "
    "corridor_congestion_recurrence:3 corridor_severe_rate:3 corridor_speed_collapse_rate:3 corridor_match_confidence_avg:3 "
    "corridor_jam_pressure_score:3",
    lambda x: x.jam_summary, JAM_SUMMARY, "jam_summary")

BEHAVIOR = JAM_SUMMARY + f""",
jb0 AS (SELECT *, ROUND(CASE WHEN p_std > 0 THEN (peak_hour_intensity - p_mean)/p_std ELSE 0 END, 4) AS jam_anomaly_score,
        quantile_cont(corridor_jam_pressure_score, 0.75) OVER () AS p75 FROM jam_summary),
jb AS (SELECT *, CASE WHEN corridor_norm = 'UNRESOLVED' THEN 'SIN_OBSERVACION_SUFFICIENTE'
   WHEN active_congestion_hours >= 8 AND corridor_jam_pressure_score >= p75*0.65 THEN 'CONGESTION_RECURRENTE'
   WHEN active_congestion_hours >= 4 AND corridor_speed_collapse_rate >= 0.35 THEN 'BAJA_VELOCIDAD_PERSISTENTE'
   WHEN active_congestion_hours <= 3 AND (corridor_jam_pressure_score >= p75 OR jam_anomaly_score >= 2) THEN 'PICO_PUNTUAL'
   WHEN active_congestion_hours <= 3 AND corridor_severe_rate >= 0.5 THEN 'CONGESTION_SEVERA_AISLADA'
   WHEN corridor_jam_pressure_score < p75*0.25 THEN 'BAJA_PRESION_OBSERVADA' ELSE 'PRESION_INTERMEDIA' END AS corridor_congestion_type,
   ROUND(100*(0.70*(active_congestion_hours/24e0) + 0.30*corridor_match_confidence_avg), 4) AS waze_observation_coverage_jams,
   corridor_norm <> 'UNRESOLVED' AS observed_corridor_flag FROM jb0)"""

add("jam_behavior",
    "corridor_norm jams_count_total active_congestion_hours jam_anomaly_score:2 corridor_jam_pressure_score:3 "
    "corridor_congestion_type observed_corridor_flag waze_observation_coverage_jams:3",
    lambda x: jam_plan.corridor_behavior(x.jam_summary), BEHAVIOR, "jb")

add("jam_profile", "corridor_norm event_hour intensity:2",
    lambda x: x.jam_summary.select("corridor_norm", F.posexplode("corridor_hour_profile").alias("event_hour", "intensity")),
    JAM_PANEL + """,
pr AS (SELECT k.corridor_norm, CAST(k.h AS INT) AS event_hour, COALESCE(p.jam_intensity_total, 0) AS intensity
       FROM (SELECT * FROM (SELECT DISTINCT corridor_norm FROM jam_panel), range(24) t(h)) k
       LEFT JOIN jam_panel p ON p.corridor_norm = k.corridor_norm AND p.event_hour = k.h)""", "pr")

add("heat_matrix", "corridor_norm h0:2 h7:2 h12:2 h18:2 h23:2",
    lambda x: jam_plan.heat_matrix(x.jam_panel, x.jam_summary, "corridor_norm", "corridor_jam_pressure_score", "jam_intensity_total")
    .withColumnsRenamed({str(h): f"h{h}" for h in range(24)}),
    JAM_SUMMARY + """,
hm AS (SELECT corridor_norm, """ + ", ".join(
        f"COALESCE(sum(jam_intensity_total) FILTER (event_hour = {h}), 0) AS h{h}" for h in (0, 7, 12, 18, 23)) + """
       FROM jam_panel WHERE corridor_norm IN (SELECT corridor_norm FROM jam_summary ORDER BY corridor_jam_pressure_score DESC, corridor_norm LIMIT 20)
       GROUP BY corridor_norm)""", "hm")

add("top_corridors", "corridor_norm corridor_delay_burden:2 corridor_jam_pressure_score:3",
    lambda x: top_rows(x.jam_summary, 30, F.desc("corridor_jam_pressure_score"), "corridor_norm"), JAM_SUMMARY,
    "(SELECT * FROM jam_summary ORDER BY corridor_jam_pressure_score DESC, corridor_norm LIMIT 30)")

add("top_jams", "uuid corridor_norm jam_intensity_score:3 delay_density:3",
    lambda x: top_rows(x.jams, 50, F.desc("jam_intensity_score"), "uuid"), JAMS,
    "(SELECT * FROM jams ORDER BY jam_intensity_score DESC, uuid LIMIT 50)")

add("jam_layers", "corridor_norm corridor_norm_key segments length_m:1 corridor_jam_pressure_score:3",
    lambda x: jam_layers(x.jam_summary, x.segments)
    .groupBy("corridor_norm", "corridor_norm_key", "corridor_jam_pressure_score")
    .agg(F.count(F.lit(1)).alias("segments"), F.sum("length_m").alias("length_m")),
    f"{JAM_SUMMARY}, jl AS (SELECT corridor_norm, {tcompact('corridor_norm')} AS corridor_norm_key, count(*) AS segments, sum(length_m) AS length_m, "
    f"max(corridor_jam_pressure_score) AS corridor_jam_pressure_score FROM jam_summary JOIN seg ON {tcompact('corridor_norm')} = {tcompact('road_key_norm')} "
    "WHERE corridor_norm <> 'UNRESOLVED' GROUP BY ALL)", "jl")

# --- norms and text ----------------------------------------------------------


def _norms(x):
    o = x.view("jam_obs").withColumn("level_d", F.col("level").cast("double"))
    fitted = norms.fit_robust(o, {"delay": 0.95, "length": 0.99, "level_d": 1.0})
    return o.select("id", *[fitted.of(c).alias(f"{c}_norm") for c in ("delay", "length", "level_d")])


add("norm_robust", "id delay_norm:6 length_norm:6 level_d_norm:6", _norms,
    f"{cte('jam_obs')}, n AS (SELECT id, {norm('delay')} AS delay_norm, {norm('length', .99)} AS length_norm, "
    f"{norm('CAST(level AS DOUBLE)', 1.0)} AS level_d_norm FROM jam_obs)", "n")


def _scales(x):
    o = x.view("jam_obs")
    fitted = norms.fit_scale(o, ["delay", "speedkmh"])
    return o.select("id", fitted.of("delay").alias("delay_scaled"), fitted.of("speedkmh").alias("speed_scaled"))


add("norm_scale", "id delay_scaled:6 speed_scaled:6", _scales,
    f"{cte('jam_obs')}, n AS (SELECT id, {scale('delay')} AS delay_scaled, {scale('speedkmh')} AS speed_scaled FROM jam_obs)", "n")


def _max(x):
    top = norms.fit_max(x.table("events"), ["value"])
    return x.table("events").select("event_id", (F.col("value") / top["value"]).alias("value_norm"),
                                    (F.log1p("value") / F.log1p(F.lit(top["value"]))).alias("value_log"))


add("norm_max", "event_id value_norm:6 value_log:6", _max,
    "n AS (SELECT event_id, value / GREATEST(max(value) OVER (), 1e0) AS value_norm, ln(1+value)/ln(1+GREATEST(max(value) OVER (), 1e0)) AS value_log FROM events)", "n")

add("text_compact", "doc_id compact", lambda x: x.table("documents").select("doc_id", text_fn.compact_text(F.col("text")).alias("compact")),
    None, f"(SELECT doc_id, {compact('text')} AS compact FROM documents)")
add("text_tags", "page_id plain", lambda x: x.table("pages").select("page_id", text_fn.compact_text(F.col("html")).alias("plain")),
    None, f"(SELECT page_id, {compact('html')} AS plain FROM pages)")
add("text_titles", "conv_id turn title", lambda x: x.table("conversations").withColumn("_c", text_fn.traffic_compact(F.col("text")))
    .select("conv_id", "turn", text_fn.road_title(F.col("_c")).alias("title")),
    f"c AS (SELECT conv_id, turn, {tcompact('text')} AS t FROM conversations), r AS (SELECT conv_id, turn, {title('t')} AS title FROM c)", "r")
add("route_refs", "way_id refs n_refs",
    lambda x: x.view("road_piece").select("way_id", ref_fn.route_refs(F.col("ref"), F.col("name")).alias("_r"))
    .select("way_id", F.array_join("_r", ";").alias("refs"), F.size("_r").alias("n_refs")),
    f"{cte('road_piece')}, r AS (SELECT way_id, {refs(ttext('ref') + chr(32) + '||' + repr(' ') + '||' + ttext('name'))} AS l FROM road_piece), "
    "s AS (SELECT way_id, array_to_string(l, ';') AS refs, CAST(len(l) AS INT) AS n_refs FROM r)", "s")


def _periods(x):
    return jam_plan.add_time(x.view("jam_obs")).groupBy("event_hour", "time_period", "is_peak_morning", "is_peak_evening", "is_night").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("event_date_local").alias("days"))


add("time_periods", "event_hour time_period is_peak_morning is_peak_evening is_night rows days", _periods,
    f"""{cte('jam_obs')}, t AS (SELECT CAST(hour(ts - INTERVAL 6 HOURS) AS INT) AS event_hour, CAST(ts - INTERVAL 6 HOURS AS DATE) AS d FROM jam_obs),
p AS (SELECT event_hour, CASE WHEN event_hour <= 5 THEN 'madrugada' WHEN event_hour <= 9 THEN 'pico_manana' WHEN event_hour <= 11 THEN 'media_manana'
 WHEN event_hour <= 13 THEN 'mediodia' WHEN event_hour <= 16 THEN 'tarde' WHEN event_hour <= 19 THEN 'pico_tarde' ELSE 'noche' END AS time_period,
 event_hour BETWEEN 6 AND 9 AS is_peak_morning, event_hour BETWEEN 17 AND 19 AS is_peak_evening, event_hour >= 20 OR event_hour <= 5 AS is_night,
 count(*) AS rows, count(DISTINCT d) AS days FROM t GROUP BY ALL)""", "p")

# --- roads and resolution pieces ---------------------------------------------

add("alias_match", "txt key corridor_norm priority:1",
    lambda x: best_contained(x.unique_jams.select(F.col("street_norm").alias("txt")), "txt", x.lookups.aliases, "key",
                             F.struct("priority", F.length("key"), "key"), ["key", "corridor_norm", "priority"]),
    f"""{ALIASES}, {UNIQUE}, tt AS (SELECT DISTINCT {road('street_modal')} AS txt FROM jam1),
am AS (SELECT txt, key, corridor_norm, priority FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY priority DESC, length(key) DESC, key DESC) rn
 FROM tt JOIN alias_lookup ON contains(txt, key)) WHERE rn = 1)""", "am")
add("ref_lookup", "key name road_type length_km:3 departments", lambda x: x.lookups.refs, ROADS, "ref_lookup")
add("name_lookup", "key name road_type length_km:3 departments", lambda x: x.lookups.names, ROADS, "name_lookup")


def _alert_texts(x):
    texts = x.view("alert").select("street", (F.coalesce(text_fn.traffic_compact(F.col("city")), F.lit("")) != "").alias("has_city"))
    return resolve_texts(texts.withColumns({"start_node": F.lit(""), "end_node": F.lit("")}), x.lookups)


add("resolve_texts", "street has_city corridor_norm corridor_group corridor_match_method corridor_match_confidence corridor_resolution_detail",
    _alert_texts,
    f"{ROADS}, {ALIASES}, {cte('alert')}, {resolve('SELECT street, ' + tcompact('city') + chr(32) + chr(60) + chr(62) + repr('') + ' AS has_city FROM alert')}",
    "resolved")
