"""Traffic jams: observations → unique jams → corridors → hour panel → summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import clip, number_or, rounded, time_period, to_local
from corridor_spark.functions.refs import descriptive_part, refs_in, street_parts
from corridor_spark.functions.text import expand_road_words, plain, road_title, traffic_compact, traffic_text
from corridor_spark.lexicons import HOURS_PER_DAY
from corridor_spark.operators.norms import exact_quantiles, fit_robust, weighted
from corridor_spark.operators.tables import ensure_columns, first_by, mode_nonblank

OBSERVATION_COLUMNS = {
    "uuid": "string", "id": "string", "ts": "string", "city": "string", "street": "string", "start_node": "string",
    "end_node": "string", "country": "string", "level": "int", "delay": "double", "length": "double",
    "speedkmh": "double",
}


def add_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Local date, hour, minute, named period, peak and night flags of a UTC time column."""
    local = to_local(F.col(ts), dict(df.dtypes)[ts])
    df = df.withColumn("datetime_local", local)
    hour = F.col("event_hour")
    return df.withColumns(
        {
            "event_date_local": F.to_date("datetime_local"),
            "event_hour": F.hour("datetime_local"),
            "event_minute": F.minute("datetime_local"),
        }
    ).withColumns(
        {
            "time_period": time_period(hour),
            "is_peak_morning": F.coalesce(hour.between(6, 9), F.lit(False)),
            "is_peak_evening": F.coalesce(hour.between(17, 19), F.lit(False)),
            "is_night": F.coalesce((hour >= 20) | (hour <= 5), F.lit(False)),
        }
    )


def _measures(name: str, short: str, kinds: str) -> list[Column]:
    col = F.col(name).cast("double")
    made = {
        "max": lambda: F.max(col), "min": lambda: F.min(col), "mean": lambda: F.avg(col),
        "median": lambda: F.percentile(col, 0.5), "std": lambda: F.stddev_pop(col),
        "range": lambda: F.max(col) - F.min(col),
    }
    return [made[k]().alias(f"{short}_{k}") for k in kinds.split()]


def unique_jams(observations: DataFrame) -> DataFrame:
    """One row per jam: earliest time, most frequent texts, extremes, centre and spread of its observations.

    One shuffle on ``uuid`` after map-side combining. *First* means earliest
    (time, id). Medians and modes hold a jam's distinct values, not its rows.
    """
    obs = ensure_columns(observations, OBSERVATION_COLUMNS)
    out = obs.groupBy("uuid").agg(
        first_by(F.col("id"), F.struct("ts", "id")).alias("id"),
        F.min("ts").alias("ts_first"),
        *[mode_nonblank(F.col(c)).alias(f"{c}_modal") for c in ("city", "street", "start_node", "end_node", "country")],
        *_measures("level", "level", "max median mean range"),
        *_measures("delay", "delay", "max median mean std range"),
        *_measures("length", "length", "max median mean std range"),
        *_measures("speedkmh", "speed", "min median mean std range"),
        F.count(F.lit(1)).alias("records_per_uuid"),
    )
    return add_time(out, "ts_first")


def add_texts(jams: DataFrame) -> DataFrame:
    """Normalised texts, references and presence flags."""
    raw = {"street": "street_modal", "start_node": "start_node_modal", "end_node": "end_node_modal"}
    jams = jams.withColumns({f"_{name}": traffic_text(F.col(col)) for name, col in raw.items()})
    jams = jams.withColumns(
        {
            **{f"{name}_norm": expand_road_words(plain(F.col(f"_{name}"))) for name in raw},
            "city_norm": traffic_compact(F.col("city_modal")),
            "route_ref": F.array_join(refs_in(F.concat_ws(" ", *[f"_{name}" for name in raw])), ";"),
            "_parts": street_parts(F.col("_street")),
        }
    )
    parts = [f"{name}_norm" for name in raw]
    return jams.withColumns(
        {
            "road_name_candidate": road_title(descriptive_part(F.col("_parts"))),
            "road_text_combined": F.trim(F.regexp_replace(F.concat_ws(" ", *parts), " +", " ")),
            "has_street": F.col("street_norm") != "",
            "has_nodes": (F.col("start_node_norm") != "") | (F.col("end_node_norm") != ""),
            "has_route_ref": F.col("route_ref") != "",
        }
    ).drop("_parts", *[f"_{name}" for name in raw])


def speed_category(speed: Column) -> Column:
    return (
        F.when(speed.isNull(), "SIN_DATO")
        .when(speed <= 2, "DETENIDO")
        .when(speed <= 5, "CASI_DETENIDO")
        .when(speed <= 10, "MUY_LENTO")
        .when(speed <= 20, "LENTO")
        .otherwise("MODERADO")
    )


def stability_class(value: Column) -> Column:
    return F.when(value >= 0.80, "HIGH").when(value >= 0.55, "MEDIUM").otherwise("LOW")


def add_metrics(jams: DataFrame) -> DataFrame:
    """Load, density, intensity, stability and reliability. Pass a staged table: bounds are fitted first."""
    low_speed = 1 / F.greatest(F.col("speed_min"), F.lit(1.0))
    norms = fit_robust(
        jams,
        {"level_max": 1.0, "delay_max": 0.95, "length_max": 0.95, "low_speed_component": 0.95,
         "speed_range": 0.95, "delay_range": 0.95, "length_range": 0.95, "level_range": 1.0,
         "records_per_uuid": 0.95},
        {"low_speed_component": low_speed},
    )
    ranges = [norms.of(c) for c in ("speed_range", "delay_range", "length_range", "level_range")]
    jams = jams.withColumns(
        {
            "delay_min": number_or(F.col("delay_max")) / 60,
            "length_km": number_or(F.col("length_max")) / 1000,
            "speed_category": speed_category(F.col("speed_min")),
            "speed_collapse_flag": F.coalesce(F.col("speed_min") <= 5, F.lit(False)),
            "severe_jam_flag": F.coalesce(F.col("level_max") >= 4, F.lit(False)),
            "extreme_jam_flag": F.coalesce(F.col("level_max") == 5, F.lit(False)),
            "low_speed_component": low_speed,
            "jam_intensity_score": rounded(
                100 * weighted([(0.30, norms.of("level_max")), (0.30, norms.of("delay_max")),
                                (0.25, norms.of("length_max")), (0.15, norms.of("low_speed_component", low_speed))]), 4),
            "jam_estimation_stability": rounded(
                clip(1 - (ranges[0] + ranges[1] + ranges[2] + ranges[3]) / 4, 0, 1), 4),
        }
    )
    return jams.withColumns(
        {
            "congestion_load": F.col("delay_min") * F.col("length_km"),
            "delay_density": F.col("delay_min") / F.greatest(F.col("length_km"), F.lit(0.001)),
            "jam_estimation_stability_class": stability_class(F.col("jam_estimation_stability")),
            "congestion_reliability_proxy": rounded(
                100 * weighted([(0.35, norms.of("records_per_uuid")), (0.40, F.col("jam_estimation_stability")),
                                (0.25, F.col("corridor_match_confidence_score"))]), 4),
        }
    )


def _is(col: str, value: str) -> Column:
    return F.count_if(F.coalesce(F.col(col) == value, F.lit(False)))


def hour_panel(jams: DataFrame) -> DataFrame:
    """Measures per corridor and local hour."""
    panel = jams.groupBy(F.col("corridor_norm_group").alias("corridor_norm"), "event_hour").agg(
        F.count(F.lit(1)).alias("jams_count"),
        F.sum("records_per_uuid").alias("records_count"),
        F.sum("delay_min").alias("delay_total_min"),
        F.avg("delay_min").alias("delay_avg_min"),
        F.sum("length_km").alias("length_total_km"),
        F.avg("length_km").alias("length_avg_km"),
        F.avg("speed_mean").alias("avg_speed_kmh"),
        F.min("speed_min").alias("min_speed_kmh"),
        F.avg("level_mean").alias("level_avg"),
        F.max("level_max").alias("level_max"),
        F.count_if("severe_jam_flag").alias("severe_jam_count"),
        F.count_if("extreme_jam_flag").alias("extreme_jam_count"),
        F.count_if("speed_collapse_flag").alias("speed_collapse_count"),
        F.sum("congestion_load").alias("congestion_load_total"),
        F.avg("delay_density").alias("delay_density_avg"),
        F.sum("jam_intensity_score").alias("jam_intensity_total"),
        F.avg("jam_intensity_score").alias("jam_intensity_avg"),
        F.avg("jam_estimation_stability").alias("estimation_stability_avg"),
        _is("corridor_match_confidence", "HIGH").alias("high_confidence_jams"),
        _is("corridor_match_confidence", "MEDIUM").alias("medium_confidence_jams"),
        _is("corridor_match_confidence", "LOW").alias("low_confidence_jams"),
        _is("corridor_match_status", "UNRESOLVED").alias("unresolved_jams"),
    )
    n = F.greatest(F.col("jams_count"), F.lit(1))
    return panel.withColumns(
        {
            "severe_jam_rate": rounded(F.col("severe_jam_count") / n, 4),
            "speed_collapse_rate": rounded(F.col("speed_collapse_count") / n, 4),
        }
    )


def _peak(hour: str, value: str) -> list[Column]:
    """Hour with the largest value (the earliest on ties) and that value."""
    at = F.max(F.struct(F.col(value), (-F.col(hour)).alias("_h")))
    return [(-at["_h"]), at[value]]


def corridor_summary(panel: DataFrame) -> DataFrame:
    """Totals, rates, peak hour, volatility and pressure per corridor, with the 24-hour profile.

    One grouping: the peak is an arg-max, and the profile fills absent hours
    with 0 from the group's own hour map.
    """
    peak_hour, peak_value = _peak("event_hour", "jam_intensity_total")
    summary = panel.groupBy("corridor_norm").agg(
        F.sum("jams_count").alias("jams_count_total"),
        F.sum("records_count").alias("records_count_total"),
        F.countDistinct("event_hour").alias("active_congestion_hours"),
        F.sum("delay_total_min").alias("corridor_delay_burden"),
        F.sum("length_total_km").alias("corridor_length_burden"),
        F.sum("congestion_load_total").alias("corridor_congestion_load"),
        F.avg("avg_speed_kmh").alias("corridor_avg_speed"),
        F.min("min_speed_kmh").alias("corridor_min_speed"),
        F.sum("severe_jam_count").alias("severe_jam_count_total"),
        F.sum("speed_collapse_count").alias("speed_collapse_count_total"),
        F.sum("jam_intensity_total").alias("jam_intensity_total"),
        F.avg("estimation_stability_avg").alias("estimation_stability_avg"),
        F.sum("high_confidence_jams").alias("high_confidence_jams"),
        F.sum("medium_confidence_jams").alias("medium_confidence_jams"),
        F.sum("low_confidence_jams").alias("low_confidence_jams"),
        F.sum("unresolved_jams").alias("unresolved_jams"),
        peak_hour.alias("peak_congestion_hour"),
        peak_value.alias("peak_hour_intensity"),
        F.stddev_pop("jam_intensity_total").alias("congestion_volatility"),
        F.filter(F.collect_list(F.struct("event_hour", "jam_intensity_total")), lambda x: x.event_hour.isNotNull())
        .alias("_hours"),
    )
    n = F.greatest(F.col("jams_count_total"), F.lit(1))
    summary = summary.withColumns(
        {
            "corridor_congestion_recurrence": rounded(F.col("active_congestion_hours") / HOURS_PER_DAY, 4),
            "corridor_severe_rate": rounded(F.col("severe_jam_count_total") / n, 4),
            "corridor_speed_collapse_rate": rounded(F.col("speed_collapse_count_total") / n, 4),
            "unresolved_share": rounded(F.col("unresolved_jams") / n, 4),
            "corridor_match_confidence_avg": rounded(
                (F.col("high_confidence_jams") * 1.0 + F.col("medium_confidence_jams") * 0.66
                 + F.col("low_confidence_jams") * 0.33) / n, 4),
            "corridor_hour_profile": F.transform(
                F.sequence(F.lit(0), F.lit(HOURS_PER_DAY - 1)),
                lambda h: F.coalesce(F.map_from_entries("_hours")[h], F.lit(0.0))),
        }
    ).drop("_hours")
    return summary.withColumn("corridor_low_speed_exposure", F.col("corridor_speed_collapse_rate"))


def add_pressure(summary: DataFrame) -> DataFrame:
    """Corridor jam pressure 0–100; unresolved corridors get 0. Pass a staged summary."""
    norms = fit_robust(
        summary,
        {"corridor_delay_burden": 0.95, "corridor_congestion_load": 0.95, "active_congestion_hours": 1.0,
         "corridor_severe_rate": 1.0, "corridor_speed_collapse_rate": 1.0, "jams_count_total": 0.95},
    )
    pressure = weighted(
        [(0.25, norms.of("corridor_delay_burden")), (0.20, norms.of("corridor_congestion_load")),
         (0.20, norms.of("active_congestion_hours")), (0.15, norms.of("corridor_severe_rate")),
         (0.10, norms.of("corridor_speed_collapse_rate")), (0.10, norms.of("jams_count_total"))]
    )
    return summary.withColumn(
        "corridor_jam_pressure_score",
        F.when(F.col("corridor_norm") == "UNRESOLVED", 0.0).otherwise(rounded(100 * pressure, 4)),
    )


def profile_anomaly(profile: Column) -> Column:
    """(max − mean) / population deviation of a profile, 0 when it is flat."""
    n = F.size(profile).cast("double")
    mean = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(profile, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return rounded(F.coalesce(F.try_divide(F.array_max(profile) - mean, F.sqrt(var)), F.lit(0.0)), 4)


def corridor_class(p75: float) -> Column:
    """Congestion type of a corridor from recurrence, pressure, collapse, severity and anomaly."""
    hours, pressure = F.col("active_congestion_hours"), F.col("corridor_jam_pressure_score")
    return (
        F.when(F.col("corridor_norm") == "UNRESOLVED", "SIN_OBSERVACION_SUFFICIENTE")
        .when((hours >= 8) & (pressure >= p75 * 0.65), "CONGESTION_RECURRENTE")
        .when((hours >= 4) & (F.col("corridor_speed_collapse_rate") >= 0.35), "BAJA_VELOCIDAD_PERSISTENTE")
        .when((hours <= 3) & ((pressure >= p75) | (F.col("jam_anomaly_score") >= 2)), "PICO_PUNTUAL")
        .when((hours <= 3) & (F.col("corridor_severe_rate") >= 0.50), "CONGESTION_SEVERA_AISLADA")
        .when(pressure < p75 * 0.25, "BAJA_PRESION_OBSERVADA")
        .otherwise("PRESION_INTERMEDIA")
    )


def corridor_behavior(summary: DataFrame) -> DataFrame:
    """Profile, anomaly, type and observation coverage per corridor. Takes a summary with pressure."""
    stats = exact_quantiles(summary, {"p": (F.col("corridor_jam_pressure_score"), [0.75])})
    p75 = stats["p"]["q"][0.75] or 0.0
    return summary.withColumn("jam_anomaly_score", profile_anomaly(F.col("corridor_hour_profile"))).withColumns(
        {
            "corridor_congestion_type": corridor_class(p75),
            "observed_corridor_flag": F.col("corridor_norm") != "UNRESOLVED",
            "silent_corridor_flag": F.lit(False),
            "waze_observation_coverage_jams": rounded(
                100 * (0.70 * (F.col("active_congestion_hours") / HOURS_PER_DAY)
                       + 0.30 * F.coalesce("corridor_match_confidence_avg", F.lit(0.0))), 4),
        }
    ).select(
        "corridor_norm", "jams_count_total", "active_congestion_hours", "corridor_hour_profile", "jam_anomaly_score",
        "corridor_jam_pressure_score", "corridor_severe_rate", "corridor_speed_collapse_rate",
        "corridor_congestion_recurrence", "corridor_match_confidence_avg", "corridor_congestion_type",
        "observed_corridor_flag", "silent_corridor_flag", "waze_observation_coverage_jams",
    )


def heat_matrix(panel: DataFrame, summary: DataFrame, corridor: str, order: str, value: str, n: int = 20) -> DataFrame:
    """Corridor × hour matrix of the ``n`` top corridors, absent hours 0."""
    top = summary.orderBy(F.desc(order), corridor).limit(n).select(corridor)
    kept = panel.join(F.broadcast(top), corridor, "left_semi")
    return kept.groupBy(corridor).pivot("event_hour", list(range(HOURS_PER_DAY))).agg(F.sum(value)).na.fill(0.0)
