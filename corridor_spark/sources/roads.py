"""Road network: ways → segments, pieces, catalogue and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.functions.geo import boxes_overlap, haversine_m, line_length_m, line_pieces
from corridor_spark.functions.numbers import number, number_or, rounded
from corridor_spark.functions.refs import format_ref, normalize_ref
from corridor_spark.functions.text import (
    catalog_text,
    first_nonempty,
    network_text,
    nonempty,
    road_text,
    road_title,
    text_or_blank,
    traffic_compact,
)
from corridor_spark.lexicons import DEPARTMENTS, MAJOR_HIGHWAYS, ROAD_CLASS_OTHER, ROAD_CLASSES
from corridor_spark.operators.tables import ensure_columns, mode_nonblank, with_capped_lists
from corridor_spark.sources import envelopes

ELEMENT = "type string, id bigint, geometry array<struct<lat double, lon double>>, tags map<string, string>"
NETWORK_SCHEMA = f"elements array<struct<{ELEMENT}>>"
TAGS = ("name", "ref", "alt_name", "official_name", "highway", "oneway", "lanes", "maxspeed", "surface", "bridge",
        "tunnel", "junction", "access")
SEGMENT_COLUMNS = {
    "source_department": "string", "source_department_slug": "string", "source_query_mode": "string",
    "osm_way_id": "bigint", **dict.fromkeys(TAGS, "string"), "length_m": "double",
    "road_key_norm": "string", "road_type_category": "string", "coords": "array<array<double>>",
}


def read_network(spark: SparkSession, path: str, department: str = "", slug: str = "", mode: str = "", split: bool = False) -> DataFrame:
    """Segments of road-network JSON files (ways with tags and geometry); ``split``: one large file by many tasks."""
    if split:
        elements = envelopes.records(spark, path, ELEMENT, "elements").select(F.struct("*").alias("e"))
    else:
        elements = spark.read.schema(NETWORK_SCHEMA).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    ways = elements.filter(F.col("e.type") == "way").select(
        F.lit(department).alias("source_department"),
        F.lit(slug).alias("source_department_slug"),
        F.lit(mode).alias("source_query_mode"),
        F.col("e.id").alias("osm_way_id"),
        *[text_or_blank(F.col("e.tags")[tag]).alias(tag) for tag in TAGS],
        F.transform(
            F.filter("e.geometry", lambda p: p.lon.isNotNull() & p.lat.isNotNull()), lambda p: F.array(p.lon, p.lat)
        ).alias("coords"),
    )
    return segments(ways)


def road_class(highway: Column) -> Column:
    """Road type category of a highway tag."""
    value = network_text(highway)
    out = None
    for name, tags in ROAD_CLASSES:
        hit = value.isin(*tags)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(ROAD_CLASS_OTHER)


def segments(ways: DataFrame, normalizer=network_text) -> DataFrame:
    """Segment table of ways with ``coords``: lengths, normalised names, road key and class.

    ``normalizer`` is ``network_text`` for the department network and
    ``catalog_text`` for the single-area one.
    """
    names = ("name", "ref", "alt_name", "official_name")
    ways = ensure_columns(ways, SEGMENT_COLUMNS).filter(F.size("coords") >= 2)
    ways = ways.withColumns({f"{n}_norm": normalizer(F.col(n)) for n in names})
    return ways.withColumns(
        {
            "length_m": rounded(line_length_m(F.col("coords")), 2),
            "vertices": F.size("coords"),
            "road_key_norm": F.coalesce(
                first_nonempty(*[F.col(f"{n}_norm") for n in names]),
                F.concat(F.lit("osm_way_"), F.col("osm_way_id").cast("string")),
            ),
            "road_type_category": road_class(F.col("highway")),
        }
    )


def area_segments(ways: DataFrame) -> DataFrame:
    """Segments of the single-area network, keyed by catalogue text."""
    return segments(ways, catalog_text)


def parse_geometry(df: DataFrame, col: str = "geometry_json") -> DataFrame:
    """Polyline text parsed to ``coords`` with its bounds; unusable lines are left out."""
    parsed = df.withColumn("coords", F.from_json(col, "array<array<double>>")).filter(F.size("coords") >= 2)
    return with_bounds(parsed)


def with_bounds(df: DataFrame) -> DataFrame:
    lons = F.transform("coords", lambda p: p[0])
    lats = F.transform("coords", lambda p: p[1])
    return df.withColumns(
        {"min_lon": F.array_min(lons), "max_lon": F.array_max(lons),
         "min_lat": F.array_min(lats), "max_lat": F.array_max(lats)}
    )


def pieces(segs: DataFrame, keep: Sequence[str], points: bool = False) -> DataFrame:
    """Two-point pieces of segments with ``way_id`` and kept columns.

    Zero-length pieces are dropped (alerts), or kept as ``points`` (incidents).
    """
    out = segs.select(
        F.col("osm_way_id").alias("way_id"), *keep, F.explode(line_pieces(F.col("coords"))).alias("_p")
    ).select("way_id", *keep, "_p.ax", "_p.ay", "_p.bx", F.col("_p.by").alias("by_"))
    return out if points else out.filter((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by_")))


def national(parts: Sequence[DataFrame]) -> DataFrame:
    """Department networks in one, a way shared by two departments once (the smallest department name wins)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return dedup_ways(out)


def dedup_ways(segs: DataFrame) -> DataFrame:
    key = ["osm_way_id", "coords"]
    rest = [c for c in segs.columns if c not in key]
    return segs.groupBy(*key).agg(F.min(F.struct("source_department", *[c for c in rest if c != "source_department"]))
                                  .alias("_r")).select(*key, "_r.*").select(*segs.columns)


def road_catalog(segs: DataFrame, by_department: bool = True) -> DataFrame:
    """One row per road (and department): counts, length, most frequent and distinct tag values.

    ``with_way_ids`` adds the ids of a road's ways where the table is written out.
    """
    segs = ensure_columns(segs, SEGMENT_COLUMNS)
    keys = ["source_department", "road_key_norm"] if by_department else ["road_key_norm"]
    listed = {"names": "name", "refs": "ref", "alt_names": "alt_name", "official_names": "official_name",
              "highway_values": "highway", "oneway_values": "oneway", "lanes_values": "lanes",
              "maxspeed_values": "maxspeed", "surface_values": "surface"}
    if not by_department:
        listed |= {"bridge_values": "bridge", "tunnel_values": "tunnel", "junction_values": "junction"}
    catalog = segs.groupBy(*keys).agg(
        F.count("osm_way_id").alias("segment_count"),
        rounded(F.sum("length_m") / 1000, 3).alias("length_km"),
        mode_nonblank(F.col("name")).alias("representative_name"),
        mode_nonblank(F.col("highway")).alias("predominant_highway"),
        mode_nonblank(F.col("road_type_category")).alias("predominant_road_type"),
        F.array_sort(F.collect_set(F.when(F.trim("ref") != "", F.trim("ref")))).alias("ref_list"),
        F.array_sort(F.collect_set(F.when(F.trim("name") != "", F.trim("name")))).alias("name_list"),
    )
    catalog = with_capped_lists(catalog, segs, keys, listed, 8)
    if not by_department:
        parts = ("road_key_norm", "representative_name", "names", "refs", "alt_names", "official_names")
        catalog = catalog.withColumn("search_text", catalog_text(F.concat_ws(" ", *parts)))
    return catalog


def way_ids(segs: DataFrame, by_department: bool = True) -> DataFrame:
    """Ways of each road, one row a way; the catalogue carries no lists of them."""
    keys = ["source_department", "road_key_norm"] if by_department else ["road_key_norm"]
    return segs.filter(F.col("osm_way_id").isNotNull()).select(*keys, "osm_way_id").distinct()


def with_way_ids(catalog: DataFrame, segs: DataFrame) -> DataFrame:
    """Catalogue for a written table, with the ids of a road's ways in one text."""
    keys = [c for c in ("source_department", "road_key_norm") if c in catalog.columns]
    ids = way_ids(segs, "source_department" in keys).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(
        F.array_join(F.array_sort(F.collect_list("osm_way_id")).cast("array<string>"), ";").alias("osm_way_ids"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return catalog.join(ids, same, "left").select(*catalog.columns, F.coalesce("osm_way_ids", F.lit("")).alias("osm_way_ids"))


def name_lookup(catalog: DataFrame) -> DataFrame:
    """Road key text → shown name and metadata; the longest road wins a key."""
    return _longest(catalog.withColumn("key", road_text(F.col("road_key_norm"))).filter(
        (F.col("key") != "") & ~F.col("key").startswith("osm way")
    ))


def ref_lookup(catalog: DataFrame) -> DataFrame:
    """Route reference → shown name and metadata; the longest road wins a reference."""
    parts = F.flatten(F.transform("ref_list", lambda r: F.split(r, "[;,]")))
    refs = catalog.withColumn("_part", F.explode(parts)).withColumn("key", normalize_ref(F.col("_part"))).filter(
        F.col("key") != ""
    )
    found = _longest(refs)
    bare = traffic_compact(F.col("name")) == F.col("key")
    return found.withColumn("name", F.when(bare, format_ref(F.col("key"))).otherwise(F.col("name")))


def _longest(keyed: DataFrame) -> DataFrame:
    shown = F.coalesce(first_nonempty(F.col("representative_name"), F.col("road_key_norm")), road_title(F.col("key")))
    winner = F.min(F.struct(
        (-F.col("length_km")).alias("neg"), "road_key_norm", "source_department", F.trim(shown).alias("name"),
        F.col("predominant_road_type").alias("road_type"), "length_km",
    ))
    return keyed.groupBy("key").agg(winner.alias("_w")).select(
        "key", "_w.name", "_w.road_type", "_w.length_km", F.col("_w.source_department").alias("departments")
    )


def network_summary(segs: DataFrame) -> DataFrame:
    """Length, names, one-way share, lanes and speed per highway tag."""
    return segs.groupBy("highway").agg(
        F.count("osm_way_id").alias("segmentos"),
        F.sum(number_or(F.col("length_m")) / 1000).alias("km"),
        F.count_if(nonempty(F.col("name"))).alias("vias_con_nombre"),
        F.count_if(F.lower(text_or_blank(F.col("oneway"))) == "yes").alias("vias_oneway"),
        F.avg(number(F.col("lanes"))).alias("carriles_promedio"),
        F.avg(number(F.col("maxspeed"))).alias("velocidad_promedio"),
    )


def network_coverage(segs: DataFrame) -> DataFrame:
    """Segments, catalogue roads and kilometres per department; empty departments are listed as such."""
    found = segs.groupBy("source_department").agg(
        F.count(F.lit(1)).alias("segments"),
        F.countDistinct("road_key_norm").alias("catalog_roads"),
        rounded(F.sum("length_m") / 1000, 3).alias("length_km"),
    )
    return found.withColumn("status", F.lit("OK"))


def coverage_of(segs: DataFrame, departments=DEPARTMENTS) -> DataFrame:
    """``network_coverage`` for a list of departments, with ``EMPTY`` rows."""
    wanted = segs.sparkSession.createDataFrame([(d[1], d[0]) for d in departments], "department string, slug string")
    joined = F.broadcast(wanted).join(network_coverage(segs), F.col("department") == F.col("source_department"), "left")
    return joined.select(
        "department", "slug", F.coalesce("status", F.lit("EMPTY")).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("segments", "catalog_roads", "length_km")],
    )


# --- selections --------------------------------------------------------------


def select_departments(names: Sequence[str], departments=DEPARTMENTS) -> list[tuple]:
    """Departments given by slug or by name in any spelling."""
    from corridor_spark.functions.text import _folding

    single_from, single_to, _, _ = _folding()
    table = str.maketrans(single_from, single_to)
    wanted = {n.strip().lower().translate(table).replace(" ", "_") for n in names if n.strip()}
    if not wanted:
        return list(departments)
    return [d for d in departments if d[0] in wanted or d[1].lower().translate(table).replace(" ", "_") in wanted]


def load_segments(segs: DataFrame, departments: Sequence[str] = (), major_only: bool = True) -> DataFrame:
    """Segments of some departments (all when none is given), major classes only on request, each way once."""
    if departments:
        segs = segs.filter(F.col("source_department").isin(*departments))
    if major_only:
        segs = segs.filter(F.col("highway").isin(*MAJOR_HIGHWAYS))
    key = ["osm_way_id", "highway", "name", "ref"]
    rest = [c for c in segs.columns if c not in key]
    once = segs.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    return once.select(*key, "_r.*").withColumn("length_km", F.col("length_m") / 1000)


def segments_by_key(segs: DataFrame, keys: DataFrame, key: str = "corridor_key", major_only: bool = True) -> DataFrame:
    """Segments whose road key is listed."""
    if major_only:
        segs = segs.filter(F.col("highway").isin(*MAJOR_HIGHWAYS))
    return segs.join(keys.select(F.col(key).alias("road_key_norm")).distinct(), "road_key_norm", "left_semi")


def named_segments(segs: DataFrame) -> DataFrame:
    """Segments with a name, reference, alternative or official name."""
    names = [F.col(c) for c in ("name", "ref", "alt_name", "official_name") if c in segs.columns]
    has = F.lit(False)
    for n in names:
        text = F.lower(F.trim(text_or_blank(n)))
        has = has | ((text != "") & (text != "nan"))
    return segs.filter(has)


def longest_in_box(segs: DataFrame, box, n: int, highways: Sequence[str] = MAJOR_HIGHWAYS) -> DataFrame:
    """The ``n`` longest main roads, of which those touching the box are kept."""
    top = segs.filter(F.col("highway").isin(*highways)).orderBy(F.desc("length_m"), "osm_way_id").limit(n)
    return with_bounds(top).filter(
        boxes_overlap(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"), box)
    )


def road_keys(catalog: DataFrame, road_words: bool) -> DataFrame:
    """Distinct keys a road can be found by, over key, name, names and references."""
    normal = road_text if road_words else traffic_compact
    lists = F.concat(F.array("road_key_norm", "representative_name"), "name_list", "ref_list")
    parts = F.flatten(F.transform(lists, lambda v: F.split(v, "[;,]")))
    keys = catalog.select(F.explode(parts).alias("part")).select(normal(F.col("part")).alias("key"))
    return keys.filter((F.col("key") != "") & ~F.col("key").startswith("osm way")).distinct()


def way_lengths(piece_table: DataFrame) -> DataFrame:
    """Great-circle length of each way from its pieces."""
    return piece_table.groupBy("way_id").agg(
        F.sum(haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by_"))).alias("length_m")
    )
