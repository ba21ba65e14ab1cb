"""Data quality: field profiles, distributions, metric tables, extreme cases, conflicts, unresolved causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import distance_class, number, percent
from corridor_spark.functions.refs import is_ref_like
from corridor_spark.functions.text import nonempty, text_or_blank, traffic_compact
from corridor_spark.lexicons import ALERT_ISSUES, JAM_ISSUES, NAMED_DISTANCE, NAMED_DISTANCE_FAR, NO_TEXT_CLUE, ROAD_TERM_PATTERN, TEXT_CLUES
from corridor_spark.operators.nearest import NAMED, k_nearest
from corridor_spark.operators.norms import exact_quantiles
from corridor_spark.operators.tables import metric_rows


def field_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, nulls, blanks and distinct values of every column.

    ``approximate`` trades the exact distinct counts (one expanded aggregate)
    for sketches, for tables with many wide columns.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    row = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}|null") for c in df.columns],
        *[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "").alias(f"{c}|blank")
          for c in df.columns],
        *[distinct(F.col(c)).alias(f"{c}|distinct") for c in df.columns],
    )
    total = F.col("_total")
    structs = [
        F.struct(
            F.lit(name).alias("field"), F.lit(dtype).alias("dtype"), (total - F.col(f"{name}|null")).alias("non_null"),
            F.col(f"{name}|null").alias("null_count"), percent(F.col(f"{name}|null"), total).alias("null_pct"),
            F.col(f"{name}|blank").alias("blank_or_null_count"),
            percent(F.col(f"{name}|blank"), total).alias("blank_or_null_pct"),
            F.col(f"{name}|distinct").alias("unique_count"),
        )
        for name, dtype in df.dtypes
    ]
    return row.select(F.explode(F.array(*structs)).alias("_f")).select("_f.*")


def hourly_distribution(observations: DataFrame) -> DataFrame:
    """Records, unique jams and measure totals per local hour."""
    return observations.groupBy("event_hour").agg(
        F.count(F.lit(1)).alias("raw_records"), F.countDistinct("uuid").alias("unique_jams"),
        F.avg("level").alias("avg_level"), F.sum("delay").alias("delay_sum"), F.sum("length").alias("length_sum"),
        F.avg("speedkmh").alias("avg_speed_kmh"),
    )


QUANTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, extremes, exact quantiles, mean and population deviation of each column.

    Quantiles come from the bracketing fit, so no task holds a whole column.
    """
    stats = exact_quantiles(df, {c: (number(F.col(c).cast("string")), QUANTILES.values()) for c in columns})
    values = {c: number(F.col(c).cast("string")) for c in columns}
    row = df.agg(*[F.avg(v).alias(f"{c}|mean") for c, v in values.items()],
                 *[F.stddev_pop(v).alias(f"{c}|std") for c, v in values.items()])
    lit = lambda v: F.lit(v).cast("double")
    structs = [
        F.struct(
            F.lit(c).alias("variable"), F.lit(stats[c]["n"]).cast("bigint").alias("count"), lit(stats[c]["min"]).alias("min"),
            *[lit(stats[c]["q"][q]).alias(name) for name, q in QUANTILES.items()],
            lit(stats[c]["max"]).alias("max"), F.col(f"{c}|mean").alias("mean"), F.col(f"{c}|std").alias("std"),
        )
        for c in columns
    ]
    return row.select(F.explode(F.array(*structs)).alias("_v")).select("_v.*")


def duplicate_counts(df: DataFrame, key: str = "uuid") -> DataFrame:
    """Rows, exact duplicates and rows beyond one per key.

    Whole rows are compared by grouping on their columns, which combines on the
    map side; a row repeated very often is one group with a count.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    keys = rows.groupBy(key).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    return metric_rows(keys, [
        ("raw_rows", F.sum("_n")), ("exact_duplicate_rows", F.sum("_n") - F.sum("_d")),
        ("uuid_duplicate_rows", F.sum("_n") - F.count(F.lit(1))),
    ])


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def jam_quality(raw: DataFrame, jams: DataFrame) -> DataFrame:
    """Quality metrics of jams."""
    assigned, empty = _n(F.col("corridor_match_status") == "RESOLVED"), _n(F.col("street_norm") == "")
    total = F.count(F.lit(1))
    level = lambda v: _n(F.col("corridor_match_confidence") == v)
    return duplicate_counts(raw).unionByName(metric_rows(jams, [
        ("unique_jams_uuid", total), ("street_empty_count", empty), ("street_empty_pct", percent(empty, total)),
        ("corridor_assigned_count", assigned), ("corridor_assigned_pct", percent(assigned, total)),
        ("high_confidence_count", level("HIGH")), ("medium_confidence_count", level("MEDIUM")),
        ("low_confidence_count", level("LOW")),
        ("unresolved_count", _n(F.col("corridor_match_status") == "UNRESOLVED")),
        ("negative_delay_count", _n(F.col("delay_max") < 0)), ("zero_speed_count", _n(F.col("speed_min") == 0)),
        ("country_not_es_count", F.count_if(F.coalesce(F.col("country_modal") != "ES", F.lit(True)))),
        ("low_stability_count", _n(F.col("jam_estimation_stability_class") == "LOW")),
    ]))


def alert_quality(raw: DataFrame, alerts: DataFrame) -> DataFrame:
    """Quality metrics of alerts."""
    total = F.count(F.lit(1))
    resolved, empty = _n(F.col("corridor_match_status") == "RESOLVED"), _n(F.col("street_norm") == "")
    valid, no_city = _n(F.col("has_valid_coordinate")), F.count_if(F.col("city").isNull())
    status = lambda v: _n(F.col("osm_match_status") == v)
    return duplicate_counts(raw).unionByName(metric_rows(alerts, [
        ("unique_alerts_uuid", F.countDistinct("uuid")), ("cluster_id_unique", F.countDistinct("cluster_id")),
        ("cluster_report_count_total", F.sum("cluster_report_count")),
        ("street_empty_count", empty), ("street_empty_pct", percent(empty, total)),
        ("city_null_count", no_city), ("city_null_pct", percent(no_city, total)),
        ("valid_coordinate_count", valid), ("valid_coordinate_pct", percent(valid, total)),
        ("spatial_high_count", status("SPATIAL_HIGH")), ("spatial_medium_count", status("SPATIAL_MEDIUM")),
        ("spatial_low_review_count", status("SPATIAL_LOW_REVIEW")),
        ("spatial_far_review_count", status("SPATIAL_FAR_REVIEW")),
        ("corridor_assigned_count", resolved), ("corridor_assigned_pct", percent(resolved, total)),
        ("unresolved_count", _n(F.col("corridor_match_status") == "UNRESOLVED")),
        ("critical_alert_count", _n(F.col("is_critical_alert"))), ("safety_alert_count", _n(F.col("is_safety_alert"))),
    ]))


def extreme_jams(jams: DataFrame) -> DataFrame:
    """Jams at or above the 99th percentile of delay, length or intensity, or with odd values."""
    columns = ("delay_max", "length_max", "jam_intensity_score")
    edges = exact_quantiles(jams, {c: (F.col(c), [0.99]) for c in columns})
    keep = (F.col("delay_max") < 0) | (F.col("speed_min") == 0) | (F.col("jam_estimation_stability_class") == "LOW")
    for c in columns:
        keep = keep | (F.col(c) >= edges[c]["q"][0.99])
    return jams.filter(keep)


def extreme_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts at or above the 99th percentile of impact or reports, critical, or far from a road."""
    columns = ("alert_impact_score", "cluster_report_count")
    edges = exact_quantiles(alerts, {c: (F.col(c), [0.99]) for c in columns})
    keep = F.col("is_critical_alert") | F.col("osm_match_status").isin("SPATIAL_LOW_REVIEW", "SPATIAL_FAR_REVIEW")
    for c in columns:
        keep = keep | (F.col(c) >= edges[c]["q"][0.99])
    return alerts.filter(keep)


def unresolved(df: DataFrame) -> DataFrame:
    return df.filter(F.col("corridor_match_status") == "UNRESOLVED")


# --- issue tables ------------------------------------------------------------


def _issues(kinds: tuple[str, ...], *conditions: Column) -> Column:
    """Array of the issue codes whose condition holds for a row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), kind) for kind, cond in zip(kinds, conditions, strict=True)]))


def _flagged(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Flag the rows whose key is listed; rows without a key, often very many, take no part in the join."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    return df.filter(~blank).join(keys.withColumn(name, F.lit(True)), key, "left").unionByName(
        df.filter(blank).withColumn(name, F.lit(None).cast("boolean")))


def ambiguous(df: DataFrame, key: str, corridor: str) -> DataFrame:
    """Non-blank keys mapped to more than one corridor."""
    return df.filter(F.col(key) != "").groupBy(key).agg(F.countDistinct(corridor).alias("corridors")).filter(
        "corridors > 1").select(key)


def jam_conflicts(jams: DataFrame) -> DataFrame:
    """One row per issue of a jam's corridor."""
    p90 = exact_quantiles(jams, {"i": (F.col("jam_intensity_score"), [0.90])})["i"]["q"][0.90]
    df = _flagged(jams, ambiguous(jams, "street_norm", "corridor_norm_group"), "street_norm", "_street")
    df = _flagged(df, ambiguous(jams, "route_ref", "corridor_norm_group"), "route_ref", "_ref").withColumn(
        "_name", traffic_compact(F.col("corridor_norm_group")))
    none = F.col("corridor_norm_group") == "UNRESOLVED"
    strong = F.coalesce("jam_intensity_score", F.lit(0.0)) >= F.lit(p90)
    low = F.col("corridor_match_confidence") == "LOW"
    issues = _issues(
        JAM_ISSUES, none, none & strong, ~none & (F.col("corridor_match_method") == "TEXT_STREET"),
        ~none & (F.col("corridor_match_method") == "NODE_CONTEXT"), ~none & low & strong, ~none & is_ref_like(F.col("_name")),
        ~none & F.col("_street"), ~none & F.col("_ref"))
    kept = ["uuid", "event_hour", "city_modal", "street_modal", "route_ref", "corridor_norm_group", "corridor_group",
            "road_scope", "corridor_match_method", "corridor_match_confidence", "jam_intensity_score", "delay_min",
            "length_km", "speed_min", "level_max", "street_norm"]
    return df.select(*kept, F.explode(issues).alias("issue_type"))


def alert_conflicts(alerts: DataFrame) -> DataFrame:
    """One row per issue of an alert's corridor, place or text."""
    p90 = exact_quantiles(alerts, {"i": (F.col("alert_impact_score"), [0.90])})["i"]["q"][0.90]
    df = alerts.withColumns(
        {"_t": traffic_compact(F.col("text_corridor_norm")), "_s": traffic_compact(F.col("spatial_corridor_norm"))})
    none = F.col("corridor_norm_alert_group") == "UNRESOLVED"
    strong = F.coalesce("alert_impact_score", F.lit(0.0)) >= F.lit(p90)
    issues = _issues(
        ALERT_ISSUES, none, none & strong, F.col("osm_match_status").isin("SPATIAL_LOW_REVIEW", "SPATIAL_FAR_REVIEW"),
        (F.col("_t") != "") & (F.col("_s") != "") & (F.col("_t") != F.col("_s")), F.col("city").isNull(), ~F.col("has_street"),
        (F.col("corridor_match_confidence") == "LOW") & strong)
    kept = ["uuid", "event_hour", "type", "subtype", "alert_group", "city", "street", "route_ref", "lon", "lat",
            "nearest_osm_distance_m", "osm_match_status", "text_corridor_norm", "spatial_corridor_norm",
            "corridor_norm_alert_group", "corridor_match_source", "corridor_match_confidence", "alert_impact_score"]
    return df.select(*kept, F.explode(issues).alias("issue_type"))


# --- unresolved incidents ----------------------------------------------------


def unresolved_cause() -> Column:
    has_coord, inside = F.col("coordinate_pair_present"), F.col("coordinate_inside_sv_bbox")
    has_corridor = nonempty(F.col("corridor_norm"))
    has_road = nonempty(F.col("nearest_osm_name")) | nonempty(F.col("nearest_osm_ref"))
    good = has_coord & inside
    return (
        F.when(~has_coord & ~has_corridor, "A_SIN_COORDENADA_SIN_CORREDOR_TEXTUAL")
        .when(~has_coord, "B_SIN_COORDENADA_CON_CORREDOR_TEXTUAL")
        .when(F.col("coordinate_quality_status") == "OUTSIDE_EL_SALVADOR_BBOX", "C_COORDENADA_FUERA_SV")
        .when(F.col("osm_match_status") == "NO_NEAR_OSM_SEGMENT", "D_COORDENADA_SIN_SEGMENTO_OSM_CERCANO")
        .when(good & ~has_road & has_corridor, "E_CORREDOR_TEXTUAL_PERO_OSM_SIN_NOMBRE_REF")
        .when(good & ~has_road, "F_COORDENADA_VALIDA_PERO_OSM_SIN_NOMBRE_REF_Y_SIN_TEXTO_VIAL")
        .when(F.col("osm_match_status") == "SPATIAL_OSM_DISTANCE_CONFLICT", "G_DISTANCIA_OSM_CONFLICTIVA")
        .when(good & has_road & ~has_corridor, "H_OSM_CON_REF_NO_NORMALIZADA_O_SIN_REGLA")
        .otherwise("Z_OTRO")
    )


ACTIONS = {
    "B_SIN_COORDENADA_CON_CORREDOR_TEXTUAL": "GEOCODIFICAR_DIRECCION_O_ASOCIAR_SOLO_COMO_CORREDOR_TEXTUAL",
    "C_COORDENADA_FUERA_SV": "REVISAR_GEOCODIFICACION",
    "D_COORDENADA_SIN_SEGMENTO_OSM_CERCANO": "REVISAR_COORDENADA_O_COBERTURA_OSM",
    "E_CORREDOR_TEXTUAL_PERO_OSM_SIN_NOMBRE_REF":
        "BUSCAR_SEGMENTO_OSM_NOMBRADO_EN_RADIO_O_ACEPTAR_TEXTO_CON_BAJA_CONFIANZA",
    "F_COORDENADA_VALIDA_PERO_OSM_SIN_NOMBRE_REF_Y_SIN_TEXTO_VIAL":
        "NO_ASIGNAR_CORREDOR_SIN_REVISION;_PROBAR_NEAREST_NAMED_OSM",
    "G_DISTANCIA_OSM_CONFLICTIVA": "REVISAR_COORDENADA_VS_TERRITORIO",
    "H_OSM_CON_REF_NO_NORMALIZADA_O_SIN_REGLA": "AGREGAR_REGLA_REF_OSM_TRAS_VALIDACION",
}


def recommended_action() -> Column:
    first = F.when(F.col("road_term_present"), "REVISAR_TEXTO_O_GEOCODIFICAR").otherwise(
        "NO_USAR_PARA_CORREDOR_HASTA_TENER_UBICACION")
    out = F.when(F.col("unresolved_cause") == "A_SIN_COORDENADA_SIN_CORREDOR_TEXTUAL", first)
    for cause, action in ACTIONS.items():
        out = out.when(F.col("unresolved_cause") == cause, action)
    return out.otherwise("REVISION")


def unresolved_detail(events: DataFrame) -> DataFrame:
    """Unresolved events with cause, action and whether their text holds a road term."""
    text = F.concat_ws(" ", *[text_or_blank(F.col(c)) for c in (
        "address", "observation", "corridor_candidate", "text_corridor_norm", "nearest_osm_name", "nearest_osm_ref")])
    return events.filter(F.col("text_osm_resolution") == "UNRESOLVED").withColumns(
        {"road_term_present": text.rlike(ROAD_TERM_PATTERN), "unresolved_cause": unresolved_cause()}
    ).withColumn("recommended_action", recommended_action())


def unresolved_causes(events: DataFrame) -> DataFrame:
    """Unresolved events by cause and action."""
    return unresolved_detail(events).groupBy("unresolved_cause", "recommended_action").agg(
        F.count("uuid").alias("events"), F.sum("mentions").alias("mentions"),
        F.sum("impact_social_score").alias("impact_social"), F.count_if("fatality_flag").alias("fatality_events"),
        F.count_if("injury_flag").alias("injury_events"), F.count_if("road_term_present").alias("road_text_events"),
    )


# --- nearest named road of unnamed cases -------------------------------------


def text_clues() -> Column:
    text = F.concat_ws(" ", text_or_blank(F.col("address")), text_or_blank(F.col("observation")))
    found = F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in TEXT_CLUES]))
    return F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise(NO_TEXT_CLUE)


def unnamed_cases(events: DataFrame) -> DataFrame:
    """Unresolved events with a usable point whose nearest road has neither name nor reference."""
    blank = lambda c: F.trim(text_or_blank(F.col(c))) == ""
    return events.filter(
        (F.col("text_osm_resolution") == "UNRESOLVED") & blank("corridor_norm")
        & F.col("coordinate_quality_status").isin("VALID_POINT", "VALID_POINT_REPEATED_COORDINATE")
        & blank("nearest_osm_name") & blank("nearest_osm_ref")
    )


def named_candidates(points: DataFrame, named_pieces: DataFrame, attributes: list[str], k: int = 5,
                     radius_m: float = 750.0) -> DataFrame:
    """The ``k`` nearest named roads of each point (``point_id, x, y``)."""
    return k_nearest(points, named_pieces, radius_m, k, attributes, NAMED, digits=2)


def named_recovery(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cases with their nearest named road, distance class and text clues."""
    best = candidates.filter("candidate_rank = 1").select(
        F.col("point_id").alias("uuid"), F.col("distance_m").alias("candidate_distance_m"),
        F.col("way_id").alias("candidate_osm_way_id"))
    distance = F.col("candidate_distance_m")
    return cases.join(best, "uuid", "left").withColumns(
        {
            "text_clues": text_clues(),
            "nearest_named_status": distance_class(distance, NAMED_DISTANCE, NAMED_DISTANCE_FAR, NAMED_DISTANCE_FAR),
        }
    )


def review_points(events: DataFrame, n: int = 40) -> DataFrame:
    """First ``n`` events that need review, the strongest impact first."""
    return events.filter(
        (F.col("text_osm_resolution") == "UNRESOLVED")
        | F.col("osm_match_status").isin("SPATIAL_OSM_LOW_REVIEW", "SPATIAL_OSM_DISTANCE_CONFLICT",
                                         "NO_COORDINATE_FOR_OSM", "NO_NEAR_OSM_SEGMENT")
        | F.col("coordinate_quality_status").isin("MISSING_POINT", "OUTSIDE_EL_SALVADOR_BBOX",
                                                  "LOW_GEO_CONFIDENCE_POINT")
    ).orderBy(F.desc("impact_social_score"), "uuid").limit(n)

