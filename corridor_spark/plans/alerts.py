"""Traffic alerts: time and place → nearest road → corridor → impact → panel and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.geo import from_utm16, in_box, to_utm16, wkt_point
from corridor_spark.functions.numbers import clip, distance_class, number_or, rounded
from corridor_spark.functions.refs import refs_in
from corridor_spark.functions.text import (
    expand_road_words,
    lookup,
    network_text,
    plain,
    road_title,
    text_or_blank,
    traffic_compact,
    traffic_text,
)
from corridor_spark.lexicons import (
    ALERT_BOX,
    ALERT_DISTANCE,
    ALERT_DISTANCE_FAR,
    ALERT_DISTANCE_SCORE,
    ALERT_GROUPS,
    ALERT_SEVERITY,
    ALERT_SUBTYPE_LABELS,
    ALERT_TYPE_LABELS,
    CRITICAL_GROUPS,
    HOURS_PER_DAY,
    OPERATIONAL_GROUPS,
    SAFETY_GROUPS,
)
from corridor_spark.operators.nearest import PLANAR, Metric, nearest
from corridor_spark.operators.norms import fit_robust, weighted
from corridor_spark.operators.tables import ensure_columns
from corridor_spark.plans.jams import _is, _peak, add_time
from corridor_spark.plans.resolve import RESOLVED_COLUMNS, Lookups, corridor_group, resolve_texts, road_scope
from corridor_spark.session import stage

ALERT_COLUMNS = {
    "uuid": "string", "ts": "string", "type": "string", "subtype": "string", "city": "string", "street": "string",
    "geowkt": "string", "cluster_id": "string", "cluster_center_lon": "double", "cluster_center_lat": "double",
    "cluster_start_ts": "string", "cluster_last_ts": "string", "cluster_report_count": "int",
    "reliability": "double", "reportrating": "double", "confidence": "double",
}
#: Search radii in metres; a wider one runs only while points are left without a road.
ALERT_RADII = (200.0, 1_000.0, 5_000.0)
ROAD_ATTRIBUTES = ("way_id", "name", "ref", "alt_name", "official_name", "highway", "road_type_category",
                   "road_key_norm", "source_department", "length_m", "oneway", "lanes", "maxspeed", "surface")
GRID_M = 1000.0


def add_place(alerts: DataFrame) -> DataFrame:
    """Point, projected metres, distance to the cluster centre and cluster duration."""
    alerts = ensure_columns(alerts, ALERT_COLUMNS)
    if "lon" not in alerts.columns:
        alerts = alerts.withColumn("_p", wkt_point(F.col("geowkt"))).withColumns(
            {"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}
        ).drop("_p")
    alerts = alerts.withColumns(
        {
            "_u": to_utm16(F.col("lon"), F.col("lat")),
            "_c": to_utm16(F.col("cluster_center_lon"), F.col("cluster_center_lat")),
            "has_valid_coordinate": in_box(F.col("lat"), F.col("lon"), ALERT_BOX),
        }
    )
    seconds = F.unix_seconds(F.try_to_timestamp("cluster_last_ts")) - F.unix_seconds(
        F.try_to_timestamp("cluster_start_ts"))
    return alerts.withColumns(
        {
            "x_utm": F.col("_u.x"),
            "y_utm": F.col("_u.y"),
            "geo_cluster_distance_m": F.hypot(F.col("_u.x") - F.col("_c.x"), F.col("_u.y") - F.col("_c.y")),
            "cluster_duration_min": F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)) / 60,
        }
    ).drop("_u", "_c")


def add_texts(alerts: DataFrame) -> DataFrame:
    alerts = alerts.withColumn("_t", traffic_text(F.col("street"))).withColumn("city_norm", traffic_compact(F.col("city")))
    alerts = alerts.withColumns(
        {"street_norm": expand_road_words(plain(F.col("_t"))), "route_ref": F.array_join(refs_in(F.col("_t")), ";")}
    )
    return alerts.withColumns(
        {
            "road_text_combined": F.col("street_norm"),
            "has_street": F.col("street_norm") != "",
            "has_route_ref": F.col("route_ref") != "",
        }
    ).drop("_t")


def _by_type(table, fallback) -> Column:
    kind, sub = F.upper(text_or_blank(F.col("type"))), F.upper(text_or_blank(F.col("subtype")))
    out = None
    for type_, fragments, value in table:
        hit = kind == type_
        if fragments:
            any_of = F.lit(False)
            for fragment in fragments:
                any_of = any_of | sub.contains(fragment)
            hit = hit & any_of
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(fallback)


def add_classification(alerts: DataFrame) -> DataFrame:
    """Labels, group, base severity and severity with the report boost."""
    norms = fit_robust(alerts, {"cluster_report_count": 0.99})
    kind, sub = text_or_blank(F.col("type")), text_or_blank(F.col("subtype"))
    shown = F.when(F.trim(sub) != "", F.trim(sub)).otherwise(F.trim(kind))
    base = _by_type(ALERT_SEVERITY, 35.0)
    return alerts.withColumns(
        {
            "alert_type_norm": F.coalesce(_label(ALERT_TYPE_LABELS, kind), road_title(network_text(kind))),
            "alert_subtype_norm": F.coalesce(_label(ALERT_SUBTYPE_LABELS, sub), road_title(network_text(shown))),
            "alert_group": _by_type(ALERT_GROUPS, "OTRO"),
            "severity_base": base,
            "severity_proxy": rounded(clip(base + norms.of("cluster_report_count") * 8, 0, 100), 3),
        }
    )


def _label(table: dict[str, str], code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.upper(code)]


def road_hits(alerts: DataFrame, pieces: DataFrame, metric: Metric = PLANAR, x: str = "x_utm", y: str = "y_utm",
              radii=ALERT_RADII) -> DataFrame:
    """``uuid``, distance and attributes of the nearest road (``nearest_…`` columns) of alerts with valid points.

    ``pieces`` are in the same units as ``x`` and ``y``: projected metres by
    default, degrees with a degree metric.
    """
    attributes = [a for a in ROAD_ATTRIBUTES if a in pieces.columns]
    points = alerts.filter("has_valid_coordinate").select(
        F.col("uuid").alias("point_id"), F.col(x).alias("x"), F.col(y).alias("y")
    )
    hit = nearest(points, pieces, radii, attributes, metric, beyond=True)
    return hit.select(
        F.col("point_id").alias("uuid"),
        rounded("distance_m", 3).alias("nearest_osm_distance_m"),
        *[F.col(a).alias(f"nearest_{a}") for a in attributes],
    )


def with_roads(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """Alerts with what ``road_hits`` found for them. The rows are shuffled, so join raw alerts and ``prepare`` them
    afterwards where there are many."""
    return ensure_columns(alerts.join(hits, "uuid", "left"), {f"nearest_{a}": "string" for a in ROAD_ATTRIBUTES})


def nearest_roads(alerts: DataFrame, pieces: DataFrame, metric: Metric = PLANAR, x: str = "x_utm", y: str = "y_utm",
                  radii=ALERT_RADII) -> DataFrame:
    """All alerts, those with valid points with the attributes of their nearest road."""
    return with_roads(alerts, road_hits(alerts, pieces, metric, x, y, radii))


def projected_pieces(pieces: DataFrame) -> DataFrame:
    """Pieces with their ends in UTM metres."""
    ends = pieces.withColumns(
        {"_a": to_utm16(F.col("ax"), F.col("ay")), "_b": to_utm16(F.col("bx"), F.col("by_"))}
    )
    return ends.withColumns(
        {"ax": F.col("_a.x"), "ay": F.col("_a.y"), "bx": F.col("_b.x"), "by_": F.col("_b.y")}
    ).drop("_a", "_b")


def match_status(distance: Column) -> Column:
    return distance_class(distance, ALERT_DISTANCE, ALERT_DISTANCE_FAR, "NO_COORDINATE_FOR_OSM")


def spatial_quality() -> Column:
    distance = F.col("geo_cluster_distance_m")
    return (
        F.when(~F.col("has_valid_coordinate"), "INVALID_OR_MISSING_COORDINATE")
        .when(distance <= 10, "VALID_COORD_CLUSTER_ALIGNED")
        .when(distance <= 100, "VALID_COORD_CLUSTER_OFFSET_SMALL")
        .otherwise("VALID_COORD_CLUSTER_OFFSET_REVIEW")
    )


def spatial_street() -> Column:
    """Text of the nearest road: reference, name, alternative and official name; else its key."""
    parts = F.filter(
        F.array(*[F.trim(text_or_blank(F.col(f"nearest_{c}"))) for c in ("ref", "name", "alt_name", "official_name")]),
        lambda p: (p != "") & (F.lower(p) != "nan"),
    )
    key = network_text(F.col("nearest_road_key_norm"))
    return (
        F.when(F.size(parts) > 0, F.array_join(parts, " / "))
        .when((key != "") & ~key.startswith("osm way"), road_title(key))
        .otherwise("")
    )


def add_corridors(alerts: DataFrame, lookups: Lookups) -> DataFrame:
    """Corridor from the alert's text, from its nearest road, and the choice between them.

    A resolved road within 500 m wins, unless the text is resolved with high
    confidence to another corridor. Pass a staged table: the texts are resolved first.
    """
    alerts = alerts.withColumns(
        {
            "osm_match_status": match_status(F.col("nearest_osm_distance_m")),
            "spatial_quality": spatial_quality(),
            "_street": text_or_blank(F.col("street")),
            "_spatial": spatial_street(),
            "_city": traffic_compact(F.col("city")) != "",
        }
    ).withColumn(
        "osm_spatial_confidence_score", lookup(F.col("osm_match_status"), ALERT_DISTANCE_SCORE, 0.0)
    )
    texts = alerts.select(F.col("_street").alias("street"), F.col("_city").alias("has_city")).unionByName(
        alerts.select(F.col("_spatial").alias("street"), F.col("_city").alias("has_city"))
    )
    resolved = stage(
        resolve_texts(texts.withColumns({"start_node": F.lit(""), "end_node": F.lit("")}), lookups), "alert-texts"
    )

    def side(prefix: str, key: str) -> DataFrame:
        return resolved.select(
            F.col("street").alias(key), F.col("has_city").alias("_city"),
            F.struct(*RESOLVED_COLUMNS).alias(f"_{prefix}"),
        )

    out = alerts.join(side("text", "_street"), ["_street", "_city"], "left").join(
        side("road", "_spatial"), ["_spatial", "_city"], "left"
    )
    text, road = F.col("_text"), F.col("_road")
    out = out.withColumns(
        {"_tk": traffic_compact(text["corridor_norm"]), "_rk": traffic_compact(road["corridor_norm"])}
    )
    near = F.col("osm_match_status").isin("SPATIAL_HIGH", "SPATIAL_MEDIUM", "SPATIAL_LOW_REVIEW")
    road_ok = road["corridor_match_status"] == "RESOLVED"
    text_ok = text["corridor_match_status"] == "RESOLVED"
    by_road = near & road_ok
    overruled = by_road & text_ok & (text["corridor_match_confidence"] == "HIGH") & (F.col("_tk") != F.col("_rk"))
    out = out.withColumns(
        {
            "_chosen": F.when(overruled, text).when(by_road, road).when(text_ok, text).when(road_ok, road).otherwise(text),
            "corridor_match_source": F.when(overruled, "TEXT_FUNCTIONAL_WITH_SPATIAL_SUPPORT")
            .when(by_road, "SPATIAL_OSM").when(text_ok, "TEXT_FALLBACK").otherwise("UNRESOLVED"),
            "corridor_resolution_detail": F.when(
                overruled, F.concat("osm_match_status", F.lit(":TEXT_HIGH_OSM_LOCAL_DIFFERENT"))
            )
            .when(by_road, F.concat("osm_match_status", F.lit(":"), road["corridor_resolution_detail"]))
            .when(text_ok, text["corridor_resolution_detail"])
            .otherwise("NO_SPATIAL_OR_TEXT_CORRIDOR"),
        }
    )
    chosen = F.col("_chosen")
    refs = F.filter(F.split("route_ref", ";"), lambda r: r != "")
    out = out.withColumn("_name", traffic_compact(chosen["corridor_norm"])).withColumn(
        "corridor_group_alert", corridor_group(F.col("_name"), chosen["corridor_match_method"], refs)
    )
    nonblank = lambda c: F.nullif(F.trim(text_or_blank(c)), F.lit(""))
    return out.withColumns(
        {
            "corridor_norm_alert": chosen["corridor_norm"],
            "corridor_local_name_alert": F.coalesce(
                nonblank(F.col("nearest_name")), nonblank(F.col("nearest_ref")), chosen["corridor_local_name"]),
            "road_scope_alert": road_scope(F.col("corridor_group_alert")),
            "corridor_match_method": chosen["corridor_match_method"],
            "corridor_match_confidence": chosen["corridor_match_confidence"],
            "corridor_match_status": chosen["corridor_match_status"],
            "text_corridor_norm": text["corridor_norm"],
            "text_corridor_match_method": text["corridor_match_method"],
            "spatial_corridor_norm": road["corridor_norm"],
            "spatial_corridor_match_method": road["corridor_match_method"],
            "corridor_match_confidence_score": lookup(
                chosen["corridor_match_confidence"], {"HIGH": 1.0, "MEDIUM": 0.66, "LOW": 0.33}, 0.0),
            "corridor_norm_alert_group": F.coalesce(F.nullif(chosen["corridor_norm"], F.lit("")), F.lit("UNRESOLVED")),
        }
    ).drop("_chosen", "_text", "_road", "_tk", "_rk", "_name", "_street", "_spatial", "_city")


def add_metrics(alerts: DataFrame, staged: DataFrame | None = None) -> DataFrame:
    """Reliability, impact and category flags. Bounds are fitted first, so pass a staged table, or with ``staged``
    one that has these alerts' counts and durations row by row."""
    norms = fit_robust(alerts if staged is None else staged, {"cluster_report_count": 0.99, "cluster_duration_min": 0.99})
    share = lambda c, top: clip(number_or(F.col(c)), 0, top) / top
    spatial = F.coalesce("osm_spatial_confidence_score", F.lit(0.0))
    cluster = norms.of("cluster_report_count")
    reliability = rounded(
        100 * weighted([(0.35, share("reliability", 10)), (0.20, share("reportrating", 5)), (0.20, cluster),
                        (0.15, spatial), (0.10, share("confidence", 5))]), 3)
    alerts = alerts.withColumn("alert_reliability_proxy", reliability)
    impact = weighted([(0.48, F.col("severity_proxy")), (0.22, F.col("alert_reliability_proxy")),
                       (20 * 0.15, cluster), (20 * 0.10, norms.of("cluster_duration_min")), (20 * 0.05, spatial)])
    return alerts.withColumns(
        {
            "alert_impact_score": rounded(clip(impact, 0, 100), 3),
            "is_critical_alert": F.col("alert_group").isin(*CRITICAL_GROUPS),
            "is_safety_alert": F.col("alert_group").isin(*SAFETY_GROUPS),
            "is_operational_alert": F.col("alert_group").isin(*OPERATIONAL_GROUPS),
        }
    )


def grid_density(alerts: DataFrame, x: str = "x_utm", y: str = "y_utm", size: float = GRID_M) -> DataFrame:
    """Counts, totals and densities of each grid cell; alerts without a point have none."""
    grid = stage(
        alerts.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
            F.floor(F.col(x) / size).alias("grid_x"), F.floor(F.col(y) / size).alias("grid_y")
        ).agg(
            F.countDistinct("uuid").alias("alerts"),
            F.sum("cluster_report_count").alias("reports"),
            F.sum("alert_impact_score").alias("impact_total"),
            F.avg("severity_proxy").alias("severity_avg"),
            F.avg(x).alias("x_center"),
            F.avg(y).alias("y_center"),
        ),
        "alert-grid",
    )
    norms = fit_robust(grid, {"alerts": 0.99, "impact_total": 0.99})
    return grid.withColumns(
        {
            "alert_density": rounded(100 * norms.of("alerts"), 3),
            "impact_density": rounded(100 * norms.of("impact_total"), 3),
        }
    )


def grid_centers(grid: DataFrame) -> DataFrame:
    """Longitude and latitude of projected cell centres."""
    return grid.withColumn("_c", from_utm16(F.col("x_center"), F.col("y_center"))).withColumns(
        {"lon_center": F.col("_c.lon"), "lat_center": F.col("_c.lat")}
    ).drop("_c")


def add_density(alerts: DataFrame, grid: DataFrame, x: str = "x_utm", y: str = "y_utm", size: float = GRID_M) -> DataFrame:
    """Alerts with the counts and densities of their cell."""
    cells = grid.select(
        "grid_x", "grid_y", F.col("alerts").alias("grid_alert_count"), F.col("reports").alias("grid_report_count"),
        "alert_density", "impact_density",
    )
    keyed = alerts.withColumns({"grid_x": F.floor(F.col(x) / size), "grid_y": F.floor(F.col(y) / size)})
    placed = F.col("grid_x").isNotNull() & F.col("grid_y").isNotNull()
    return keyed.filter(placed).join(cells, ["grid_x", "grid_y"], "left").unionByName(keyed.filter(~placed), allowMissingColumns=True)


def hour_panel(alerts: DataFrame) -> DataFrame:
    """Measures per corridor and local hour."""
    panel = alerts.groupBy(F.col("corridor_norm_alert_group").alias("corridor_norm_alert"), "event_hour").agg(
        F.count(F.lit(1)).alias("alerts_count"),
        F.sum("cluster_report_count").alias("reports_count"),
        F.sum("alert_impact_score").alias("impact_total"),
        F.avg("alert_impact_score").alias("impact_avg"),
        F.avg("severity_proxy").alias("severity_avg"),
        F.sum("severity_proxy").alias("severity_total"),
        F.avg("alert_reliability_proxy").alias("reliability_avg"),
        _is("alert_group", "ACCIDENTE").alias("accident_count"),
        _is("alert_group", "CIERRE_VIAL").alias("closure_count"),
        _is("type", "HAZARD").alias("hazard_count"),
        _is("type", "JAM").alias("jam_alert_count"),
        F.count_if("is_critical_alert").alias("critical_alert_count"),
        F.count_if("is_safety_alert").alias("safety_alert_count"),
        F.count_if("is_operational_alert").alias("operational_alert_count"),
        F.count_if(F.col("osm_match_status").isin("SPATIAL_HIGH", "SPATIAL_MEDIUM")).alias("high_spatial_count"),
        _is("corridor_match_status", "UNRESOLVED").alias("unresolved_count"),
    )
    n = F.greatest(F.col("alerts_count"), F.lit(1))
    return panel.withColumns(
        {
            "critical_alert_rate": rounded(F.col("critical_alert_count") / n, 4),
            "high_spatial_rate": rounded(F.col("high_spatial_count") / n, 4),
        }
    )


def group_diversity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.col("corridor_norm_alert_group").alias("corridor_norm_alert")).agg(
        F.countDistinct("alert_group").alias("alert_group_diversity")
    )


def corridor_summary(panel: DataFrame, alerts: DataFrame) -> DataFrame:
    """Totals, rates, peak hour, group diversity and pressure per corridor."""
    peak_hour, peak_value = _peak("event_hour", "impact_total")
    totals = ("accident_count", "closure_count", "hazard_count", "jam_alert_count", "critical_alert_count",
              "safety_alert_count", "operational_alert_count", "high_spatial_count", "unresolved_count")
    summary = panel.groupBy("corridor_norm_alert").agg(
        F.sum("alerts_count").alias("alerts_count_total"),
        F.sum("reports_count").alias("reports_count_total"),
        F.countDistinct("event_hour").alias("active_alert_hours"),
        F.sum("impact_total").alias("corridor_alert_impact"),
        F.avg("severity_avg").alias("corridor_severity_avg"),
        F.avg("reliability_avg").alias("corridor_reliability_avg"),
        *[F.sum(c).alias(f"{c}_total") for c in totals],
        peak_hour.alias("peak_alert_hour"),
        peak_value.alias("peak_hour_impact"),
    )
    n = F.greatest(F.col("alerts_count_total"), F.lit(1))
    summary = summary.withColumns(
        {
            "corridor_alert_recurrence": rounded(F.col("active_alert_hours") / HOURS_PER_DAY, 4),
            "critical_alert_rate": rounded(F.col("critical_alert_count_total") / n, 4),
            "safety_alert_rate": rounded(F.col("safety_alert_count_total") / n, 4),
            "high_spatial_rate": rounded(F.col("high_spatial_count_total") / n, 4),
        }
    ).join(group_diversity(alerts), "corridor_norm_alert", "left")
    summary = stage(summary, "alert-summary")
    norms = fit_robust(
        summary,
        {"alerts_count_total": 0.95, "corridor_alert_impact": 0.95, "reports_count_total": 0.95,
         "active_alert_hours": 1.0, "critical_alert_rate": 1.0, "corridor_reliability_avg": 0.95},
    )
    pressure = weighted(
        [(0.24, norms.of("alerts_count_total")), (0.24, norms.of("corridor_alert_impact")),
         (0.16, norms.of("reports_count_total")), (0.14, norms.of("active_alert_hours")),
         (0.12, norms.of("critical_alert_rate")), (0.10, norms.of("corridor_reliability_avg"))]
    )
    return summary.withColumn(
        "corridor_alert_pressure",
        F.when(F.col("corridor_norm_alert") == "UNRESOLVED", 0.0).otherwise(rounded(100 * pressure, 4)),
    )


def type_ranking(alerts: DataFrame) -> DataFrame:
    """Counts, reports, impact and averages per group and shown type."""
    return alerts.groupBy("alert_group", "alert_type_norm", "alert_subtype_norm").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.sum("cluster_report_count").alias("reports"),
        F.sum("alert_impact_score").alias("impact_total"),
        F.avg("severity_proxy").alias("severity_avg"),
        F.avg("alert_reliability_proxy").alias("reliability_avg"),
    )


def distribution(alerts: DataFrame, *keys: str) -> DataFrame:
    """Alerts, reports and mean ratings per key (hour, type and subtype, or city)."""
    return alerts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alerts"),
        F.sum("cluster_report_count").alias("reports"),
        F.avg("reliability").alias("avg_reliability"),
        F.avg("reportrating").alias("avg_report_rating"),
    )


def prepare(alerts: DataFrame) -> DataFrame:
    """Time, place and text columns of raw alerts."""
    return add_texts(add_place(add_time(alerts)))

