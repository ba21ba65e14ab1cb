"""News incidents: all-text CSV with nested JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.functions.geo import in_box
from corridor_spark.functions.numbers import number, number_or, safe_float, text_bool
from corridor_spark.functions.text import nonempty
from corridor_spark.lexicons import COUNTRY_BOX
from corridor_spark.operators.tables import ensure_columns

RAW_COLUMNS = ("uuid", "ticketNumber", "datetime", "incident", "department", "municipality", "address", "observation",
               "latitude", "longitude", "source", "reliability", "evidence")
MENTION_FIELDS = (
    "mention_id", "source", "source_item_id", "tweet_status_id_ref", "canonical_url", "url", "published_at",
    "event_datetime", "is_relevant", "relevance_confidence", "relevance_reason_code", "is_followup_update", "needs_maps",
    "maps_reason", "title", "context_summary", "raw_text", "content_hash", "content_fingerprint", "municipality",
    "department", "latitude", "longitude", "geo_confidence", "geo_validation_status", "maps_country_code",
    "maps_country_name",
)
ENGAGEMENT = ("likes", "comments", "shares", "quotes", "views")


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """Incident CSV: every column as text, blanks kept, quoted line breaks allowed."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.na.fill("", [c for c, t in df.dtypes if t == "string"])


def items(json: Column) -> Column:
    """Elements of a JSON array as variants; anything else gives an empty array.

    The parser stops at the end of the array, so text after it is tested here.
    """
    parsed = F.try_parse_json(F.when(F.trim(json).startswith("[") & F.trim(json).endswith("]"), json))
    return F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array().cast("array<variant>"))


def is_object(item: Column) -> Column:
    """Only objects can be taken as a struct; unlike the item's schema, this does not look at the values inside."""
    return F.try_variant_get(item, "$", "struct<_:string>").isNotNull()


def field(item: Column, name: str, dtype: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{name}", dtype)


def engagement(item: Column) -> Column:
    """Snapshots of a mention as variants; none when the field is no list."""
    return F.coalesce(field(item, "engagement", "array<variant>"), F.array().cast("array<variant>"))


def engagement_texts(item: Column) -> Column:
    """Snapshots of a mention as texts, taken out in one pass; null for an element that is no object."""
    kind = ",".join(f"{name}:string" for name in ("captured_at", *ENGAGEMENT))
    return F.coalesce(field(item, "engagement", f"array<struct<{kind}>>"), F.array().cast(f"array<struct<{kind}>>"))


def snapshot(item: Column, index: Column) -> Column:
    """Typed snapshot; an element that is no object has null parts."""
    return F.struct(
        index.alias("snapshot_index"),
        field(item, "captured_at").alias("captured_at"),
        *[number(field(item, name)).alias(name) for name in ENGAGEMENT],
        is_object(item).alias("ok"),
    )


def mentions(raw: DataFrame) -> DataFrame:
    """One row per evidence object, with the values of its last array snapshot."""
    exploded = raw.select(
        F.col("uuid").alias("event_uuid"), "ticketNumber", F.col("datetime").alias("event_datetime_row"),
        F.posexplode(items(F.col("evidence"))).alias("_pos", "_m"),
    ).filter(is_object(F.col("_m")))
    renamed = {"event_datetime": "event_datetime_mention"}
    typed = exploded.select(
        "event_uuid", "ticketNumber", "event_datetime_row", (F.col("_pos") + 1).alias("mention_order"),
        *[field(F.col("_m"), f).alias(renamed.get(f, f)) for f in MENTION_FIELDS],
        F.transform(engagement(F.col("_m")), snapshot).alias("engagement"),
    )
    last = F.element_at("engagement", -1)
    return typed.withColumn("engagement_snapshots", F.size("engagement")).withColumns(
        {f"latest_{n}": F.when(F.size("engagement") > 0, last[n]) for n in (*ENGAGEMENT, "captured_at")}
    )


def snapshots(mention_rows: DataFrame) -> DataFrame:
    """One row per engagement snapshot object."""
    return mention_rows.select(
        "event_uuid", "ticketNumber", "mention_id", "source", "published_at", F.explode("engagement").alias("_s")
    ).filter("_s.ok").select(
        "event_uuid", "ticketNumber", "mention_id", "source", "published_at", "_s.snapshot_index", "_s.captured_at",
        *[f"_s.{n}" for n in ENGAGEMENT],
    )


def latest_engagement(mention_rows: DataFrame) -> DataFrame:
    """Newest snapshot by capture time of each mention, summed per event."""
    newest = F.max_by(F.struct(*ENGAGEMENT), F.struct("_ts", "snapshot_index"))
    rows = snapshots(mention_rows.withColumn("mention_id", F.col("mention_order").cast("string"))).withColumn(
        "_ts", F.coalesce(F.unix_micros(F.try_to_timestamp("captured_at")), F.lit(-(2**62)))
    )
    per_mention = rows.groupBy("event_uuid", "mention_id").agg(newest.alias("_n"), F.count(F.lit(1)).alias("_s"))
    return per_mention.groupBy("event_uuid").agg(
        *[F.sum(F.coalesce(F.col(f"_n.{n}"), F.lit(0.0))).alias(f"latest_{n}") for n in ENGAGEMENT],
        F.count(F.lit(1)).alias("engagement_mentions"),
        F.sum("_s").alias("engagement_snapshots"),
    )


# --- typed loads -------------------------------------------------------------

EVENT_NUMBERS = ("mentions", "latest_likes", "latest_comments", "latest_shares", "latest_quotes", "latest_views",
                 "impact_social_score", "engagement_mentions", "metric_score_0_100", "event_hour", "severity_score",
                 "nearest_osm_distance_m", "fatality_flag", "injury_flag", "vulnerable_user_flag", "heavy_vehicle_flag")
EVENT_FLAGS = ("coordinate_pair_present", "coordinate_inside_sv_bbox", "repeated_coordinate_flag")


def load_events(events: DataFrame) -> DataFrame:
    """Event table typed for interactive queries: numbers, flags, date and heat weights."""
    kept = set(events.columns)
    typed = events.withColumns({c: number_or(F.col(c).cast("double")) for c in EVENT_NUMBERS if c in kept})
    typed = typed.withColumns({c: text_bool(F.col(c), ("true",)) for c in EVENT_FLAGS if c in kept})
    return typed.withColumns(
        {
            "event_date_dt": F.to_date(F.try_to_timestamp(F.col("datetime").cast("string"))),
            "latitude_num": number(F.col("latitude_num").cast("string")),
            "longitude_num": number(F.col("longitude_num").cast("string")),
            "heat_weight_eventos": F.lit(1),
            "heat_weight_menciones": F.greatest(F.col("mentions"), F.lit(0.0)),
            "heat_weight_impacto_social": F.greatest(F.col("impact_social_score"), F.lit(0.0)),
        }
    )


CONTEXT_COLUMNS = {"corridor_candidate": "string", "road_context_level": "string", "capital_analysis_eligible": "boolean",
                   "capital_scope": "string", "capital_subarea": "string"}


def load_base_events(events: DataFrame) -> DataFrame:
    """Events of the source evaluation with availability flags."""
    events = ensure_columns(events, CONTEXT_COLUMNS)
    blank_free = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return events.withColumns(
        {
            "event_id": F.col("uuid"),
            "address_available": blank_free("address"),
            "municipality_available": blank_free("municipality"),
            "department_available": blank_free("department"),
            "road_context_available": blank_free("corridor_candidate"),
            "has_original_coordinates": in_box(
                safe_float(F.col("latitude")), safe_float(F.col("longitude")), COUNTRY_BOX),
            "capital_analysis_eligible": F.coalesce("capital_analysis_eligible", F.lit(False)),
        }
    )
