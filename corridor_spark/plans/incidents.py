"""News incidents: raw rows → events → nearest road → corridor → score → tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions import incident_text as it
from corridor_spark.functions.geo import in_box
from corridor_spark.functions.numbers import distance_class, number, number_or, percent, rounded, safe_float
from corridor_spark.functions.text import compact_text, lookup, nonempty, text_or_blank
from corridor_spark.lexicons import (
    CAPITAL_BOX,
    COUNTRY_BOX,
    EVENT_SCORE_CLASSES,
    EVENT_SCORE_WEIGHTS,
    GEO_COMPONENT,
    INCIDENT_DISTANCE,
    INCIDENT_DISTANCE_FAR,
    KNOWN_CORRIDORS,
    ROAD_COMPONENT,
    WEIGHT_PROFILES,
)
from corridor_spark.operators.nearest import LOCAL, nearest, nearest_by_bounds
from corridor_spark.operators.norms import fit_max, weighted
from corridor_spark.operators.tables import ensure_columns, metric_rows, rollup_table, unique_join
from corridor_spark.plans.resolve import resolve_incident
from corridor_spark.session import stage
from corridor_spark.sources import incidents as source
from corridor_spark.sources import road_store
from corridor_spark.sources.roads import pieces as road_pieces
from corridor_spark.sources.roads import with_bounds

SEARCH_DEGREES = 0.035
#: The last radius stays inside ``SEARCH_DEGREES`` of longitude at the country's latitudes,
#: so a hit is always one the bounds rule would have found.
INCIDENT_RADII = (200.0, 1_000.0, 3_700.0)
ROAD_FIELDS = {"way_id": "nearest_osm_way_id", "name": "nearest_osm_name", "ref": "nearest_osm_ref",
               "highway": "nearest_osm_highway", "road_key_norm": "nearest_osm_road_key_norm",
               "road_type_category": "nearest_osm_road_type", "oneway": "nearest_osm_oneway",
               "lanes": "nearest_osm_lanes", "maxspeed": "nearest_osm_maxspeed", "surface": "nearest_osm_surface"}
GOOD_MATCH = ("SPATIAL_OSM_HIGH", "SPATIAL_OSM_MEDIUM")
ACCEPTED = ("COMPATIBLE", "LOCAL_NAME_WITHIN_CORRIDOR", "INTERSECTION_ACCEPTED")


def _newest(snaps: Column) -> Column:
    """Newest snapshot of a mention's ``engagement_texts`` by capture time (the later item on ties), null when it has none.

    Time and place among the items decide; the numbers are read of the newest alone.
    """
    return F.array_max(F.transform(snaps, lambda s, i: F.when(s.isNotNull(), F.struct(
        F.coalesce(F.unix_micros(F.try_to_timestamp(s.captured_at)), F.lit(-(2**62))).alias("t"), i.alias("i"), s.alias("s")))))


def events(raw: DataFrame, known: dict = KNOWN_CORRIDORS) -> DataFrame:
    """Event rows: JSON columns summarised in place, text features, territory, coordinates.

    No shuffle: evidence and engagement are reduced inside their row.
    """
    raw = ensure_columns(raw, dict.fromkeys(source.RAW_COLUMNS, "string"))
    raw = raw.withColumns(
        {
            "_rel": F.try_parse_json(F.when(nonempty(F.col("reliability")), F.col("reliability"))),
            "_items": source.items(F.col("evidence")),
            "_obs": compact_text(F.col("observation")),
            "_addr": compact_text(F.col("address")),
            "_inc": compact_text(F.col("incident")),
            "_dep": compact_text(F.col("department")),
            "_mun": compact_text(F.col("municipality")),
        }
    )
    raw = raw.withColumns(
        {
            "_objects": F.filter("_items", source.is_object),
            "_snaps": F.transform(F.filter("_items", source.is_object), source.engagement_texts),
            "_links": F.filter(
                F.coalesce(F.try_variant_get("_rel", "$.links", "array<variant>"), F.array().cast("array<variant>")),
                source.is_object),
            "_text": F.concat_ws(" ", "_addr", "_obs"),
            **it.severity_flags(F.col("_obs")),
        }
    )
    raw = raw.withColumns(
        {
            "_newest": F.transform(F.filter(F.transform("_snaps", _newest), lambda n: n.isNotNull()), lambda n: F.struct(
                *[number(n.s[name]).alias(name) for name in source.ENGAGEMENT])),
            "_sources": F.array_sort(F.array_distinct(F.filter(
                F.transform("_objects", lambda m: source.field(m, "source")), nonempty))),
            "_scores": F.array_compact(F.transform("_links", lambda v: safe_float(source.field(v, "dedupe_score")))),
            "_known": it.known_corridors(F.col("_text"), known),
            "_kms": it.km_references(F.col("_text")),
            "engagement_snapshots": F.aggregate(
                F.transform("_snaps", F.size), F.lit(0), lambda a, n: a + n),
            "engagement_mentions": F.size(F.filter("_snaps", lambda s: F.size(s) > 0)),
        }
    )
    # Every distinct road name is kept: a name contained in a longer one does not replace it.
    raw = raw.withColumn(
        "_roads", F.array_sort(F.array_distinct(F.concat("_known", it.road_phrases(F.col("_text"))))))
    total = lambda n: F.aggregate(
        F.transform("_newest", lambda s: F.coalesce(s[n], F.lit(0.0))), F.lit(0.0), lambda a, v: a + v)
    positive = lambda path: F.nullif(F.try_variant_get("_rel", path, "bigint"), F.lit(0))
    raw = raw.withColumns(
        {
            **{f"latest_{n}": total(n) for n in source.ENGAGEMENT},
            "primary_road_candidate": F.coalesce(F.get("_roads", F.lit(0)), F.lit("")),
            "intersection_candidate": it.crossing(F.col("_text"), F.col("_roads")),
            "mentions": F.coalesce(positive("$.mentions"), F.size("_items").cast("bigint")),
            "links_count": F.coalesce(positive("$.links_count"), F.size("_items").cast("bigint")),
            "geo_confidence": rounded(F.coalesce(F.try_variant_get("_rel", "$.geo_confidence", "double"), F.lit(0.0)), 4),
            "_dt": F.try_to_timestamp(F.col("datetime").cast("string")).cast("timestamp_ntz"),
        }
    )
    decision = lambda d: F.size(F.filter("_links", lambda v: source.field(v, "decision") == d))
    latest = [F.col(f"latest_{n}") for n in source.ENGAGEMENT]
    out = raw.withColumns(
        {
            "severity_class": it.severity_class(F.col("_inc")),
            "severity_score": it.severity_score(F.col("_inc")),
            "event_datetime": F.col("_dt"),
            "event_date": F.to_date("_dt"),
            "event_hour": F.hour("_dt"),
            "event_weekday": F.date_format("_dt", "EEEE"),
            "department_norm": it.department_name(F.col("_dep")),
            "municipality_norm": it.municipality_name(F.col("_mun")),
            "territory_normalization_status": it.territory_status(F.col("department"), F.col("municipality")),
            "source_diversity": F.size("_sources"),
            "source_list": F.array_join("_sources", "; "),
            "merge_links": decision("MERGE"),
            "new_links": decision("NEW"),
            "max_dedupe_score": rounded(F.array_max("_scores"), 4),
            "latitude_num": safe_float(F.col("latitude").cast("string")),
            "longitude_num": safe_float(F.col("longitude").cast("string")),
            "has_address": nonempty(F.col("address")),
            "has_municipality": nonempty(F.col("municipality")),
            "has_department": nonempty(F.col("department")),
            "road_name_candidates": F.array_join("_roads", "; "),
            "corridor_candidate": F.coalesce(F.get("_known", F.lit(0)), F.col("primary_road_candidate")),
            "km_references": F.array_join("_kms", "; "),
            "road_context_level": it.context_level(F.col("_roads"), F.col("intersection_candidate"), F.col("_kms")),
            "road_type_candidate": it.road_type(F.col("primary_road_candidate"), F.col("_text")),
            "impact_social_score": it.impact(*latest),
            "impact_raw_sum": rounded(latest[0] + latest[1] + latest[2] + latest[3] + latest[4], 4),
        }
    )
    out = out.withColumn("road_context_available", F.col("road_context_level") != "NO_ROAD_CONTEXT")
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def add_coordinates(events: DataFrame) -> DataFrame:
    """Point flags, reuse of the same coordinate and quality status.

    Reuse is counted per coordinate and joined back: a coordinate shared by
    very many events is one row of the count, never one task of a window.
    """
    lat, lon = F.col("latitude_num"), F.col("longitude_num")
    key = F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat_ws(",", F.format_string("%.6f", lat), F.format_string("%.6f", lon)),
    )
    events = events.withColumns(
        {
            "coordinate_pair_present": lat.isNotNull() & lon.isNotNull(),
            "coordinate_inside_sv_bbox": in_box(lat, lon, COUNTRY_BOX),
            "coordinate_inside_amss_bbox": in_box(lat, lon, CAPITAL_BOX),
            "coordinate_key_6dec": key,
        }
    )
    reuse = events.filter("coordinate_key_6dec is not null").groupBy("coordinate_key_6dec").agg(
        F.count(F.lit(1)).alias("coordinate_reuse_count")
    ).filter("coordinate_reuse_count > 1")
    events = events.join(reuse, "coordinate_key_6dec", "left").withColumn(
        "coordinate_reuse_count",
        F.coalesce("coordinate_reuse_count", F.when(F.col("coordinate_pair_present"), 1).otherwise(0)),
    )
    return events.withColumns(
        {
            "coordinate_key_6dec": F.coalesce("coordinate_key_6dec", F.lit("")),
            "repeated_coordinate_flag": F.col("coordinate_reuse_count") > 1,
            "coordinate_quality_status": F.when(~F.col("coordinate_pair_present"), "MISSING_POINT")
            .when(~F.col("coordinate_inside_sv_bbox"), "OUTSIDE_EL_SALVADOR_BBOX")
            .when(F.coalesce("geo_confidence", F.lit(0.0)) < 0.5, "LOW_GEO_CONFIDENCE_POINT")
            .when(F.col("coordinate_reuse_count") > 1, "VALID_POINT_REPEATED_COORDINATE")
            .otherwise("VALID_POINT"),
        }
    )


def nearest_roads(events: DataFrame, pieces: DataFrame, ways: DataFrame, national: bool = True) -> DataFrame:
    """Events with their nearest road: own department's network, else the whole one where ``national`` says so.

    ``pieces`` and ``ways`` are the whole network (``ways`` with coordinates).
    Each scope runs the radius steps, then the bounds rule for what is left.
    """
    fields = [f for f in ROAD_FIELDS if f in pieces.columns]
    events, located = _scoped(events, ways.select("source_department").distinct(), national, False)
    hits = [_nearest_in(located.filter((F.col("scope") == road_store.DEPARTMENT) == F.lit(own)), pieces, ways, fields, own)
            for own in (True, False)]
    return _with_roads(events, hits[0].unionByName(hits[1]), fields)


def nearest_stored(events: DataFrame, store: DataFrame) -> DataFrame:
    """Events with their nearest road from a road store.

    An event goes to its department's network, without one to the national network,
    without that and inside the capital's box to the capital's, else to none. Each
    network is a search of its own that opens only that network's folders, and of
    the departments only those that events name.
    """
    fields = [f for f in ROAD_FIELDS if f in store.columns or f == "way_id"]
    has = {name: not road_store.network(store, name).isEmpty() for name in (road_store.NATIONAL, road_store.CAPITAL)}
    events, located = _scoped(events, road_store.stored_departments(store), has[road_store.NATIONAL], has[road_store.CAPITAL])
    hits = None
    for name in (road_store.DEPARTMENT, *[n for n in has if has[n]]):
        own = name == road_store.DEPARTMENT
        points = located.filter(F.col("scope") == name)
        if not points.isEmpty():
            ways = road_store.departments_of(points, store) if own else road_store.network(store, name)
            pieces = road_pieces(ways, [*[f for f in fields if f != "way_id"], "source_department"], points=True)
            found = _nearest_in(points, pieces, ways, fields, own)
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no event has a network
        kinds = dict(store.dtypes) | {"way_id": dict(store.dtypes)["osm_way_id"]}
        hits = store.sparkSession.createDataFrame([], ", ".join(
            ["point_id string", "distance_m double", *[f"{f} {kinds[f]}" for f in fields]]))
    return _with_roads(events, hits, fields)


def _scoped(events: DataFrame, departments: DataFrame, national: bool, capital: bool) -> tuple[DataFrame, DataFrame]:
    """Events with the network they are matched to, and those of them that have a point to match."""
    events = events.join(departments.select(F.col("source_department").alias("department_norm"), F.lit(True).alias("_own")),
                         "department_norm", "left")
    scope = F.when(F.col("_own"), road_store.DEPARTMENT)
    if national:
        scope = scope.otherwise(road_store.NATIONAL)
    elif capital:
        scope = scope.when(F.col("coordinate_inside_amss_bbox"), road_store.CAPITAL).otherwise("NO_OSM_NETWORK")
    else:
        scope = scope.otherwise("NO_OSM_NETWORK")
    events = events.withColumn("nearest_osm_source_scope", scope).withColumn(
        "nearest_osm_source_department",
        F.when(F.col("_own"), F.col("department_norm"))
        .when(F.col("nearest_osm_source_scope") == road_store.NATIONAL, "NACIONAL")
        .when(F.col("nearest_osm_source_scope") == road_store.CAPITAL, "SAN SALVADOR")
        .otherwise(""),
    ).drop("_own")
    located = stage(
        events.filter(
            F.col("coordinate_pair_present") & F.col("coordinate_inside_sv_bbox")
            & (F.col("nearest_osm_source_scope") != "NO_OSM_NETWORK")
        ).select(F.col("uuid").alias("point_id"), F.col("longitude_num").alias("x"), F.col("latitude_num").alias("y"),
                 F.col("nearest_osm_source_scope").alias("scope"), F.col("department_norm").alias("source_department")),
        "incident-points",
    )
    return events, located


def _nearest_in(points: DataFrame, pieces: DataFrame, ways: DataFrame, fields: list[str], own: bool) -> DataFrame:
    """Nearest road of points in a network, or in their department's part of it with ``own``."""
    keys = ["source_department"] if own else []
    near = stage(nearest(points, pieces, INCIDENT_RADII, fields, LOCAL, keys), "incident-near")
    left = points.join(near.select("point_id"), "point_id", "left_anti")
    rest = _by_bounds(left, with_bounds(ways.withColumnRenamed("osm_way_id", "way_id")), fields, own)
    return near if rest is None else near.unionByName(rest)


def _with_roads(events: DataFrame, hits: DataFrame, fields: list[str]) -> DataFrame:
    hits = hits.select(
        F.col("point_id").alias("uuid"), rounded("distance_m", 2).alias("nearest_osm_distance_m"),
        *[F.col(f).alias(ROAD_FIELDS[f]) for f in fields],
    )
    out = ensure_columns(events.join(hits, "uuid", "left"), {c: "string" for c in ROAD_FIELDS.values()})
    return out.withColumn("osm_match_status", match_status())


def _by_bounds(points: DataFrame, ways: DataFrame, fields: list[str], own: bool) -> DataFrame | None:
    if points.isEmpty():
        return None
    return nearest_by_bounds(points, ways, SEARCH_DEGREES, fields, keys=["source_department"] if own else [])


def match_status() -> Column:
    point, scope = F.col("coordinate_quality_status"), F.col("nearest_osm_source_scope")
    return (
        F.when(point == "MISSING_POINT", "NO_COORDINATE_FOR_OSM")
        .when(point == "OUTSIDE_EL_SALVADOR_BBOX", "INVALID_POINT_FOR_OSM")
        .when(scope == "NO_OSM_NETWORK", "NO_OSM_NETWORK_FOR_POINT")
        .when((scope == "AMSS") & ~F.col("coordinate_inside_amss_bbox"), "OUTSIDE_AMSS_OSM_SCOPE")
        .otherwise(distance_class(F.col("nearest_osm_distance_m"), INCIDENT_DISTANCE, INCIDENT_DISTANCE_FAR,
                                  "NO_NEAR_OSM_SEGMENT"))
    )


def text_consistency(df: DataFrame) -> DataFrame:
    """Does the text's corridor agree with the nearest road's name, reference or key?"""
    df = df.withColumns(
        {
            "_c": compact_text(F.col("corridor_candidate")),
            "_o": compact_text(F.concat_ws(" ", *[
                text_or_blank(F.col(c)) for c in ("nearest_osm_name", "nearest_osm_ref", "nearest_osm_road_key_norm")])),
        }
    )
    c, o = F.col("_c"), F.col("_o")
    cw, ow = F.split(c, " "), F.split(o, " ")
    overlap = F.size(F.array_intersect(cw, ow)) / F.size(F.array_union(cw, ow))
    status = (
        F.when(c == "", "NO_TEXT_TO_VALIDATE")
        .when(o == "", "NO_OSM_TO_VALIDATE")
        .when(o.contains(c) | c.contains(o), "TEXT_SPATIAL_CONSISTENT")
        .when(overlap >= 0.45, "TEXT_SPATIAL_REVIEW")
        .otherwise("TEXT_SPATIAL_CONFLICT")
    )
    return df.withColumn("text_spatial_consistency", status).drop("_c", "_o")


def enrich(events: DataFrame, pieces: DataFrame, ways: DataFrame) -> DataFrame:
    """Nearest road, text consistency and corridor resolution."""
    return resolve_incident(text_consistency(nearest_roads(events, pieces, ways)))


def add_score(events: DataFrame) -> DataFrame:
    """Exploratory score 0–100 and its category. Pass a staged table: maxima are fitted first."""
    top = fit_max(events, ["mentions", "impact_social_score"])
    row = events.agg(F.min(F.unix_micros(F.col("event_datetime").cast("timestamp"))).alias("lo"),
                     F.max(F.unix_micros(F.col("event_datetime").cast("timestamp"))).alias("hi")).first()
    lo = row["lo"] if row["lo"] is not None else 0
    span = max(((row["hi"] or 0) - lo) / 1e6, 1.0)
    seconds = (F.unix_micros(F.col("event_datetime").cast("timestamp")) - F.lit(lo)) / 1e6
    log_share = lambda c: F.least(F.log1p(F.col(c).cast("double")) / F.log1p(F.lit(top[c])), F.lit(1.0)) * 100
    events = events.withColumns(
        {
            "severity_component": F.col("severity_score") * 100,
            "mentions_component": log_share("mentions"),
            "source_diversity_component": F.least(F.col("source_diversity") / 3.0, F.lit(1.0)) * 100,
            "impact_social_component": log_share("impact_social_score"),
            "geo_quality_component": lookup(F.col("coordinate_quality_status"), GEO_COMPONENT, 0),
            "osm_association_component": lookup(F.col("osm_match_status"), ROAD_COMPONENT, 0),
            "temporal_recency_component": F.coalesce(seconds / F.lit(span) * 100, F.lit(0.0)),
        }
    )
    score = rounded(weighted((w, F.col(c)) for c, w in EVENT_SCORE_WEIGHTS), 2)
    category = None
    for upper, name in EVENT_SCORE_CLASSES:
        hit = F.col("metric_score_0_100") <= upper
        category = F.when(hit, name) if category is None else category.when(hit, name)
    return events.withColumn("metric_score_0_100", score).withColumn("metric_category", category)


# --- tables ------------------------------------------------------------------


def _n(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def measures() -> dict[str, Column]:
    """Every measure the incident tables use, by output name."""
    flag = lambda c: _n(F.col(c))
    return {
        "events": F.count("uuid"),
        "traffic_accidents": _n(F.col("incident") == "TRAFFIC_ACCIDENT"),
        "mentions": F.sum("mentions"),
        "source_diversity_max": F.max("source_diversity"),
        "impact_social": F.sum("impact_social_score"),
        "avg_impact_social": F.avg("impact_social_score"),
        "severity_sum": F.sum("severity_score"),
        "avg_severity": F.avg("severity_score"),
        "valid_points": flag("coordinate_inside_sv_bbox"),
        "amss_points": flag("coordinate_inside_amss_bbox"),
        "repeated_coordinate_events": flag("repeated_coordinate_flag"),
        "address_events": flag("has_address"),
        "fatality_events": flag("fatality_flag"),
        "injury_events": flag("injury_flag"),
        "vulnerable_events": flag("vulnerable_user_flag"),
        "heavy_vehicle_events": flag("heavy_vehicle_flag"),
        "osm_high_medium": _n(F.col("osm_match_status").isin(*GOOD_MATCH)),
        "compatible_events": _n(F.col("text_osm_resolution").isin(*ACCEPTED)),
        "review_events": _n(F.col("text_osm_resolution") == "REVIEW_COORDINATE_OR_NAME"),
        "unresolved_events": _n(F.col("text_osm_resolution") == "UNRESOLVED"),
        "corridor_candidates": unique_join(F.when(nonempty(F.col("corridor_candidate")), F.col("corridor_candidate"))),
        "departments": unique_join(F.col("department_norm")),
        "municipalities": unique_join(F.col("municipality_norm")),
        "road_type_candidate": unique_join(F.col("road_type_candidate")),
        "avg_osm_distance_m": F.avg("nearest_osm_distance_m"),
        "avg_distance_m": F.avg("nearest_osm_distance_m"),
        "avg_metric_score": F.avg("metric_score_0_100"),
        "avg_metric": F.avg("metric_score_0_100"),
        "views": F.sum("latest_views"),
        "shares": F.sum("latest_shares"),
        "likes": F.sum("latest_likes"),
        "first_event": F.min("event_datetime"),
        "last_event": F.max("event_datetime"),
    }


_BASE = ("events", "mentions", "impact_social", "severity_sum", "valid_points")
#: Table name → (keys, measures, kept rows).
TABLES = {
    "departments": (("department_norm",), ("events", "traffic_accidents", "mentions", "impact_social", "severity_sum",
                                           "valid_points", "address_events", "avg_metric_score"), None),
    "municipalities": (("department_norm", "municipality_norm"), (*_BASE, "address_events", "avg_metric_score"), None),
    "territory_normalization": (
        ("department_raw", "department_norm", "municipality_raw", "municipality_norm", "territory_normalization_status"),
        ("events", "mentions", "impact_social"), None),
    "corridors": (("corridor_candidate",), (*_BASE, "fatality_events", "injury_events", "vulnerable_events",
                                            "avg_metric_score"), "corridor_candidate"),
    "corridors_norm": (("corridor_norm",), (*_BASE, "fatality_events", "injury_events", "vulnerable_events",
                                            "osm_high_medium", "compatible_events", "review_events",
                                            "corridor_candidates", "avg_metric_score"), "corridor_norm"),
    "osm_road_type": (("nearest_osm_road_type",), ("events", "mentions", "impact_social", "avg_distance_m"), None),
    "daily": (("event_date",), ("events", "traffic_accidents", "mentions", "impact_social", "views", "shares",
                                "valid_points", "avg_metric_score"), None),
    "hourly": (("event_hour",), ("events", "mentions", "impact_social", "views", "shares", "avg_metric_score"), None),
}
CRITICAL_MEASURES = (
    "events", "mentions", "source_diversity_max", "impact_social", "avg_impact_social", "severity_sum", "avg_severity",
    "fatality_events", "injury_events", "vulnerable_events", "heavy_vehicle_events", "valid_points",
    "repeated_coordinate_events", "amss_points", "osm_high_medium", "avg_osm_distance_m", "avg_metric_score",
    "first_event", "last_event", "departments", "municipalities", "road_type_candidate", "corridor_candidates",
    "compatible_events", "review_events",
)


def aggregate(events: DataFrame, name: str) -> DataFrame:
    """One of the grouped incident tables."""
    keys, wanted, kept = TABLES[name]
    if kept:
        events = events.filter(nonempty(F.col(kept)))
    if name == "territory_normalization":
        events = events.withColumns(
            {
                "department_raw": F.when(nonempty(F.col("department")), F.trim("department")).otherwise("SIN_DEPTO"),
                "municipality_raw": F.when(nonempty(F.col("municipality")), F.trim("municipality")).otherwise(
                    "SIN_MUNICIPIO"),
            }
        )
    known = measures()
    return rollup_table(events, keys, {m: known[m] for m in wanted})


def critical_corridors(events: DataFrame) -> DataFrame:
    """Corridors by criticality: eight measures scaled by their maxima and weighted."""
    known = measures()
    stats = stage(
        rollup_table(events.filter(nonempty(F.col("corridor_norm"))), ["corridor_norm"],
                     {m: known[m] for m in CRITICAL_MEASURES}), "critical-corridors")
    weights = WEIGHT_PROFILES["ACTUAL_PIPELINE"]
    top = fit_max(stats, weights)
    score = 100 * weighted((w, F.col(c).cast("double") / F.lit(top[c])) for c, w in weights.items())
    return stats.withColumn("corridor_criticality_score", rounded(score, 2))


def corridor_diagnostics(events: DataFrame) -> DataFrame:
    """Coverage of text corridors and normalised corridors as metric rows."""
    text, norm = nonempty(F.col("corridor_candidate")), nonempty(F.col("corridor_norm"))
    in_text = lambda c: _n(text & c)
    whole = events.agg(
        F.count(F.lit(1)).alias("all"), _n(text).alias("text"), F.sum("impact_social_score").alias("impact"),
        F.countDistinct(F.when(text, F.col("corridor_candidate"))).alias("text_names"), _n(norm).alias("norm"),
        F.countDistinct(F.when(norm, F.col("corridor_norm"))).alias("norm_names"),
        in_text(F.col("coordinate_inside_sv_bbox")).alias("valid"),
        in_text(F.col("coordinate_inside_amss_bbox")).alias("amss"),
        in_text(F.col("osm_match_status").isin(*GOOD_MATCH)).alias("good"),
        F.sum(F.when(text, F.col("impact_social_score")).otherwise(0.0)).alias("text_impact"),
    )
    none = F.lit(None).cast("double")
    rows = (
        ("eventos_con_corredor_textual", "text", percent(F.col("text"), F.col("all"))),
        ("corredores_distintos_extraidos", "text_names", none),
        ("eventos_con_corredor_norm", "norm", percent(F.col("norm"), F.col("all"))),
        ("corredores_norm_distintos", "norm_names", none),
        ("eventos_con_corredor_y_coordenada_valida", "valid", percent(F.col("valid"), F.col("text"))),
        ("eventos_con_corredor_en_bbox_amss", "amss", percent(F.col("amss"), F.col("text"))),
        ("eventos_con_corredor_y_osm_alto_medio", "good", percent(F.col("good"), F.col("text"))),
        ("impacto_social_en_corredores", "text_impact", percent(F.col("text_impact"), F.col("impact"))),
    )
    structs = [F.struct(F.lit(m).alias("metric"), rounded(F.col(c).cast("double"), 4).alias("value"),
                        p.alias("percent")) for m, c, p in rows]
    return whole.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def integrity(events: DataFrame, mentions: int, snapshots: int) -> DataFrame:
    """Integrity metrics of the event table, with the row counts of the child tables."""
    flag = lambda c: _n(F.col(c))
    sums = {"likes_ultimo_snapshot": "latest_likes", "comments_ultimo_snapshot": "latest_comments",
            "shares_ultimo_snapshot": "latest_shares", "quotes_ultimo_snapshot": "latest_quotes",
            "views_ultimo_snapshot": "latest_views", "impacto_social_ponderado_total": "impact_social_score",
            "impacto_raw_total": "impact_raw_sum"}
    return metric_rows(
        events,
        [
            ("eventos_totales", F.count(F.lit(1))),
            ("menciones_expandidas", F.lit(mentions), False),
            ("snapshots_engagement", F.lit(snapshots), False),
            ("eventos_con_lat_lon", flag("coordinate_pair_present")),
            ("eventos_con_lat_lon_dentro_sv_bbox", flag("coordinate_inside_sv_bbox")),
            ("eventos_fuera_sv_bbox", _n(F.col("coordinate_quality_status") == "OUTSIDE_EL_SALVADOR_BBOX")),
            ("eventos_sin_lat_lon", _n(F.col("coordinate_quality_status") == "MISSING_POINT")),
            ("eventos_con_coordenada_repetida", flag("repeated_coordinate_flag")),
            ("eventos_con_address", flag("has_address")),
            ("eventos_con_municipio", flag("has_municipality")),
            ("eventos_con_departamento", flag("has_department")),
            ("eventos_con_contexto_vial_textual", flag("road_context_available")),
            ("eventos_con_engagement", _n(F.col("engagement_mentions") > 0)),
            ("eventos_con_multiples_menciones", _n(F.col("mentions") > 1)),
            ("eventos_con_mas_de_una_fuente", _n(F.col("source_diversity") > 1)),
            ("eventos_con_osm_alto_medio", _n(F.col("osm_match_status").isin(*GOOD_MATCH))),
            *[(name, F.sum(col), False) for name, col in sums.items()],
        ],
        F.count(F.lit(1)),
    )


def coordinate_table(events: DataFrame) -> DataFrame:
    """Events, mentions, impact and confidence per coordinate status."""
    table = events.groupBy("coordinate_quality_status").agg(
        F.count("uuid").alias("events"), F.sum("mentions").alias("mentions"),
        F.sum("impact_social_score").alias("impact_social"), F.avg("geo_confidence").alias("avg_geo_confidence"),
    )
    return table.withColumn("percent", percent(F.col("events"), table.agg(F.sum("events")).scalar()))


def engagement_by_source(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("source").agg(
        F.count("mention_id").alias("menciones"), F.countDistinct("event_uuid").alias("eventos"),
        *[F.sum(number_or(F.col(f"latest_{n}"))).alias(f"latest_{n}") for n in source.ENGAGEMENT],
    )


def engagement_by_hour(snapshots: DataFrame) -> DataFrame:
    at = F.try_to_timestamp("captured_at")
    return snapshots.groupBy(F.to_date(at).alias("captured_date"), F.hour(at).alias("captured_hour")).agg(
        F.count("mention_id").alias("snapshots"),
        *[F.sum(number_or(F.col(n))).alias(n) for n in source.ENGAGEMENT],
    )


RESOLUTION_COLUMNS = (
    "uuid", "ticketNumber", "datetime", "department_norm", "municipality_norm", "address", "corridor_candidate",
    "corridor_norm", "corridor_norm_source", "text_corridor_norm", "nearest_osm_corridor_norm", "nearest_osm_name",
    "nearest_osm_ref", "nearest_osm_highway", "nearest_osm_distance_m", "nearest_osm_source_scope", "osm_match_status",
    "text_spatial_consistency", "text_osm_resolution", "corridor_resolution_confidence", "mentions",
    "impact_social_score",
)


def resolution_table(events: DataFrame) -> DataFrame:
    return events.select(*RESOLUTION_COLUMNS)


def resolution_conflicts(events: DataFrame) -> DataFrame:
    return resolution_table(events).filter(F.col("text_spatial_consistency") == "TEXT_SPATIAL_CONFLICT")


HEAT_COLUMNS = (
    "uuid", "ticketNumber", "datetime", "event_date", "event_hour", "incident", "department", "department_norm",
    "municipality", "municipality_norm", "address", "latitude_num", "longitude_num", "coordinate_quality_status",
    "coordinate_inside_sv_bbox", "coordinate_reuse_count", "mentions", "source_diversity", "latest_likes",
    "latest_comments", "latest_shares", "latest_quotes", "latest_views", "impact_social_score", "metric_score_0_100",
    "metric_category",
)


def heat_weights(events: DataFrame) -> DataFrame:
    """Point events with their heat-map weights."""
    return events.filter("coordinate_pair_present").select(*HEAT_COLUMNS).withColumnsRenamed(
        {"latitude_num": "latitude", "longitude_num": "longitude", "mentions": "heat_weight_menciones",
         "impact_social_score": "heat_weight_impacto_social"}
    ).withColumn("heat_weight_eventos", F.lit(1))



def outputs(events: DataFrame, mentions: DataFrame, snapshots: DataFrame) -> dict[str, DataFrame]:
    """Every incident table by name, for ``sources.sinks.write_tables``."""
    return {
        "events": events, "mentions": mentions.drop("engagement"), "snapshots": snapshots,
        "integrity": integrity(events, mentions.count(), snapshots.count()), "coordinates": coordinate_table(events),
        "points": events.filter("coordinate_pair_present"), **{name: aggregate(events, name) for name in TABLES},
        "critical_corridors": critical_corridors(events), "corridor_diagnostics": corridor_diagnostics(events),
        "corridor_resolution": resolution_table(events), "resolution_conflicts": resolution_conflicts(events),
        "heat_weights": heat_weights(events), "engagement_by_source": engagement_by_source(mentions),
        "engagement_by_hour": engagement_by_hour(snapshots),
    }
