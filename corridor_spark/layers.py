"""Materialised layers over the driver tables, built once per application.

Each layer is a staged Parquet table (see ``session.stage``): the analyses are
a chain of tables, several of which feed many queries, so each is computed
once and read with column pruning afterwards. Tables that only lead to a layer
go once it is written.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark import fixtures
from corridor_spark.lexicons import MAJOR_HIGHWAYS
from corridor_spark.operators.nearest import LOCAL
from corridor_spark.plans import alerts as alert_plan
from corridor_spark.plans import incidents as incident_plan
from corridor_spark.plans import associate, evaluate, integrate
from corridor_spark.plans import jams as jam_plan
from corridor_spark.plans.resolve import Lookups, resolve_traffic
from corridor_spark.session import LONG_VALUES, scratch, stage, stage_root
from corridor_spark.sources import aliases, road_store, roads
from corridor_spark.sources import incidents as incident_source

_LAYERS: dict[tuple[str, str], "Layers"] = {}


def layers(spark: SparkSession, sf_dir: str) -> "Layers":
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LAYERS:
        _LAYERS[key] = Layers(spark, sf_dir)
    return _LAYERS[key]


class Layers:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def view(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    # --- roads ---

    @cached_property
    def segments(self) -> DataFrame:
        ways = self.view("road_piece").select(
            F.col("way_id").alias("osm_way_id"), "name", "ref", "highway",
            F.col("department").cast("string").alias("source_department"),
            F.array(F.array("ax", "ay"), F.array("bx", "by_")).alias("coords"),
        )
        return stage(roads.segments(ways), "segments")

    @cached_property
    def pieces(self) -> DataFrame:
        keep = ["name", "ref", "highway", "road_key_norm", "road_type_category", "source_department", "length_m"]
        return stage(roads.pieces(self.segments, keep), "pieces")

    @cached_property
    def catalog(self) -> DataFrame:
        return stage(roads.road_catalog(self.segments), "catalog")

    @cached_property
    def road_store(self) -> DataFrame:
        """Networks of ten departments and the national one, on disk by department and bucket of road keys."""
        return self._stored("road-store", self.segments)

    @cached_property
    def capital_store(self) -> DataFrame:
        """Networks of ten departments and, without a national one, the main roads as the capital's."""
        main = self.segments.filter(F.col("highway").isin(*MAJOR_HIGHWAYS))
        return self._stored("capital-store", None, main)

    def _stored(self, name: str, whole: DataFrame | None, capital: DataFrame | None = None) -> DataFrame:
        path = f"{stage_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        own = self.segments.filter(F.length("source_department") == 1)
        road_store.write_store(path, own, whole, capital)
        return road_store.open_store(self.spark, path)

    @cached_property
    def lookups(self) -> Lookups:
        return Lookups(
            stage(roads.name_lookup(self.catalog), "names"),
            stage(roads.ref_lookup(self.catalog), "refs"),
            stage(aliases.alias_lookup(self.view("alias")), "aliases"),
        )

    # --- jams ---

    @cached_property
    def unique_jams(self) -> DataFrame:
        return stage(jam_plan.add_texts(jam_plan.unique_jams(self.view("jam_obs"))), "unique-jams")

    @cached_property
    def resolved_jams(self) -> DataFrame:
        return stage(resolve_traffic(self.unique_jams, self.lookups), "resolved-jams")

    @cached_property
    def jams(self) -> DataFrame:
        return stage(jam_plan.add_metrics(self.resolved_jams), "jams")

    @cached_property
    def jam_panel(self) -> DataFrame:
        return stage(jam_plan.hour_panel(self.jams), "jam-panel")

    @cached_property
    def jam_summary(self) -> DataFrame:
        totals = stage(jam_plan.corridor_summary(self.jam_panel), "jam-totals")
        return stage(jam_plan.add_pressure(totals), "jam-summary")

    # --- alerts ---

    @cached_property
    def prepared_alerts(self) -> DataFrame:
        return stage(alert_plan.prepare(self.view("alert")), "prepared-alerts")

    @cached_property
    def alerts(self) -> DataFrame:
        """Alerts with road, corridor and metrics; the tables on the way go once this one is written."""
        prepared, pieces, lookups = self.prepared_alerts, self.pieces, self.lookups  # shared layers, so not made inside
        with scratch(self.spark) as keep:
            with scratch(self.spark) as keep_near:
                hits = alert_plan.road_hits(prepared, pieces, LOCAL, "lon", "lat")
                # raw rows meet the roads: the derived columns would be most of that shuffle, and deriving them again is one pass
                near = keep_near(alert_plan.prepare(alert_plan.with_roads(self.view("alert"), hits)), "near-alerts")
            placed = alert_plan.add_corridors(alert_plan.add_classification(near), lookups)
            return keep(alert_plan.add_metrics(placed, near), "alerts")

    @cached_property
    def alert_panel(self) -> DataFrame:
        return stage(alert_plan.hour_panel(self.alerts), "alert-panel")

    @cached_property
    def alert_summary(self) -> DataFrame:
        return stage(alert_plan.corridor_summary(self.alert_panel, self.alerts), "alert-summary")

    # --- integration ---

    @cached_property
    def crosswalk(self) -> DataFrame:
        return stage(integrate.crosswalk(self.jam_summary, self.alert_summary), "crosswalk")

    @cached_property
    def panel(self) -> DataFrame:
        dense = integrate.dense_panel(
            integrate.jams_by_hour(self.jams), integrate.alerts_by_hour(self.alerts), self.crosswalk
        )
        return stage(integrate.score_panel(stage(dense, "dense-panel")), "panel")

    @cached_property
    def integrated(self) -> DataFrame:
        return stage(integrate.corridor_summary(self.panel), "integrated")

    # --- incidents ---

    @cached_property
    def raw_incidents(self) -> DataFrame:
        return stage(fixtures.raw_incidents(self.spark, self.sf_dir), "raw-incidents", LONG_VALUES)

    @cached_property
    def mentions(self) -> DataFrame:
        return stage(incident_source.mentions(self.raw_incidents), "mentions", LONG_VALUES)

    @cached_property
    def snapshots(self) -> DataFrame:
        return stage(incident_source.snapshots(self.mentions), "snapshots")

    @cached_property
    def base_events(self) -> DataFrame:
        raw = self.raw_incidents
        with scratch(self.spark) as keep:
            # a batch of rows with their evidence, as long as the incident has snapshots, can exceed a task's memory
            rows = stage(incident_plan.events(raw).drop("evidence"), "event-rows")
            return keep(incident_plan.add_coordinates(rows), "base-events")

    @cached_property
    def point_pieces(self) -> DataFrame:
        keep = ["name", "ref", "highway", "road_key_norm", "road_type_category", "source_department"]
        return stage(roads.pieces(self.segments, keep, points=True), "point-pieces")

    @cached_property
    def events(self) -> DataFrame:
        base, pieces, ways = self.base_events, self.point_pieces, self.segments
        with scratch(self.spark) as keep:
            enriched = stage(incident_plan.enrich(base, pieces, ways), "enriched-events")
            return keep(incident_plan.add_score(enriched), "events")

    # --- matching models ---

    @cached_property
    def candidates(self) -> DataFrame:
        return stage(associate.road_candidates(self.catalog), "candidates")

    @cached_property
    def places(self) -> DataFrame:
        """City names of the driver tables and the department (a number) they stand for."""
        nation = self.table("nation")
        return stage(nation.select(F.concat(F.lit("city "), F.col("n_nationkey").cast("string")).alias("key"),
                                   (F.col("n_nationkey") % 14).cast("string").alias("department")), "places")

    @cached_property
    def features(self) -> DataFrame:
        return stage(associate.jam_features(self.jams, self.places), "features")

    @cached_property
    def topk(self) -> DataFrame:
        return stage(associate.operational_topk(self.features, self.candidates), "topk")

    @cached_property
    def comparison(self) -> DataFrame:
        return stage(associate.comparison(self.topk, self.features), "comparison")

    @cached_property
    def area_catalog(self) -> DataFrame:
        """Catalogue of the single-area network; its texts are made once for the passes over it, and go once it is written."""
        ways = self.segments.select("osm_way_id", "name", "ref", "highway", "coords")
        with scratch(self.spark) as keep:
            areas = stage(roads.area_segments(ways).drop("coords", "name_norm", "ref_norm", "alt_name_norm", "official_name_norm"), "area-segments")
            return keep(roads.road_catalog(areas, by_department=False), "area-catalog")

    @cached_property
    def text_matches(self) -> DataFrame:
        corridors = incident_plan.aggregate(self.events, "corridors").withColumnRenamed("corridor_candidate", "corridor")
        return stage(associate.fuzzy_matches(stage(corridors, "news-corridors"), self.area_catalog), "text-matches")

    @cached_property
    def critical(self) -> DataFrame:
        return stage(incident_plan.critical_corridors(self.events), "critical")

    # --- evaluation ---

    @cached_property
    def early(self) -> DataFrame:
        return stage(evaluate.capital_context(stage(evaluate.early_events(self.base_events), "early-events")), "early")

    @cached_property
    def evaluated(self) -> DataFrame:
        """Events with geocode columns (from their own points), text matches and road distances."""
        base = incident_source.load_base_events(self.early)
        none = self.spark.createDataFrame([], """event_id string, query_order int, lat double, lon double, display_name string,
            geocode_status string, geocode_level string, geocode_confidence double,
            geocode_usable_for_road_analysis boolean""")
        geocoded = evaluate.geocoded_events(base, none).drop("nearest_osm_distance_m")
        near = self.events.select("uuid", "nearest_osm_distance_m")
        return stage(evaluate.match_to_roads(geocoded, self.text_matches, self.point_pieces, near), "evaluated")
