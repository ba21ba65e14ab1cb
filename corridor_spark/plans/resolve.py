"""Corridor resolution: road text (and the nearest road) → one corridor name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.refs import descriptive_part, format_ref, is_ref_like, refs_in, street_parts
from corridor_spark.functions.text import (
    compact_text,
    contains_any,
    expand_road_words,
    lookup,
    nonempty,
    plain,
    road_title,
    text_or_blank,
    title_case,
    traffic_compact,
    traffic_text,
)
from corridor_spark.lexicons import (
    AMBIGUOUS_RULE,
    CONFIDENCE_SCORES,
    DEPARTMENT_PREFIXES,
    GENERIC_STREETS,
    INCIDENT_RULES,
    KNOWN_CORRIDORS,
    NATIONAL_NAME_TERMS,
    NATIONAL_PREFIXES,
    TRAFFIC_RULES,
    URBAN_NAME_TERMS,
)
from corridor_spark.operators.contains import best_contained
from corridor_spark.session import stage

RESOLVED_COLUMNS = (
    "corridor_candidate", "corridor_norm", "corridor_local_name", "corridor_group", "road_scope",
    "corridor_match_method", "corridor_match_confidence", "corridor_match_status", "unresolved_reason",
    "corridor_resolution_detail", "catalog_road_type", "catalog_length_km", "catalog_departments",
)


@dataclass(frozen=True)
class Lookups:
    """Tables a resolution reads: road names, road references and aliases, each with a ``key``."""

    names: DataFrame
    refs: DataFrame
    aliases: DataFrame


def rule_match(text: Column, refs: Column, rules=TRAFFIC_RULES) -> Column:
    """Struct (norm, method) of the first rule met by a reference or a contained alias."""
    rule_name, shared_ref, needed = AMBIGUOUS_RULE
    out = None
    for norm, rule_refs, aliases in rules:
        cases = []
        if rule_refs:
            hit = F.arrays_overlap(refs, F.array(*map(F.lit, rule_refs)))
            if norm == rule_name:
                hit = hit & (~F.array_contains(refs, shared_ref) | text.contains(needed))
            cases.append((hit, "OSM_REF"))
        cases.append((contains_any(text, aliases), "TEXT_ALIAS"))
        for hit, method in cases:
            value = F.struct(F.lit(norm).alias("norm"), F.lit(method).alias("method"))
            out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def corridor_group(name: Column, method: Column, refs: Column, alias_group: Column | None = None) -> Column:
    """Network group of a corridor, given its compact name."""

    def any_prefix(prefixes: Sequence[str]) -> Column:
        return F.exists(refs, lambda r: F.split(r, " ")[0].isin(*prefixes) & r.contains(" "))

    own = F.nullif(text_or_blank(alias_group), F.lit("")) if alias_group is not None else F.lit(None).cast("string")
    return F.coalesce(
        own,
        F.when(name == "", "UNRESOLVED")
        .when(any_prefix(NATIONAL_PREFIXES), "NACIONAL_REGIONAL")
        .when(any_prefix(DEPARTMENT_PREFIXES), "DEPARTAMENTAL_LOCAL")
        .when(contains_any(name, NATIONAL_NAME_TERMS), "NACIONAL_REGIONAL")
        .when(
            method.isin("OSM_NAME", "TEXT_ALIAS", "TEXT_ALIAS_TABLE") & contains_any(name, URBAN_NAME_TERMS),
            "URBANO_LOCAL",
        )
        .when(method == "NODE_CONTEXT", "CONTEXTO_NODO")
        .when(is_ref_like(name), "REFERENCIA_OSM_SIN_NOMBRE")
        .otherwise("LOCAL_NO_CLASIFICADO"),
    )


def road_scope(group: Column, alias_scope: Column | None = None) -> Column:
    own = F.nullif(text_or_blank(alias_scope), F.lit("")) if alias_scope is not None else F.lit(None).cast("string")
    return F.coalesce(
        own,
        F.when(group == "NACIONAL_REGIONAL", "CORREDOR_ESTRUCTURANTE")
        .when(group == "DEPARTAMENTAL_LOCAL", "REFERENCIA_DEPARTAMENTAL")
        .when(group == "URBANO_LOCAL", "VIA_URBANA")
        .when(group == "CONTEXTO_NODO", "CONTEXTO_NO_VIA")
        .when(group == "REFERENCIA_OSM_SIN_NOMBRE", "REFERENCIA_OSM_SIN_NOMBRE")
        .otherwise("NO_CLASIFICADO"),
    )


def resolve_texts(texts: DataFrame, lookups: Lookups) -> DataFrame:
    """Resolution of distinct ``street, start_node, end_node, has_city`` rows.

    Every stage is worked out for every text as a nullable result; the first
    one present, in the order of the rules, is the answer.
    """
    key = ["street", "start_node", "end_node", "has_city"]
    raw = {"_s": "street", "_a": "start_node", "_b": "end_node"}
    base = texts.select(*key).distinct().withColumns({f"{c}_t": traffic_text(F.col(col)) for c, col in raw.items()})
    base = base.withColumns(
        {
            **{c: expand_road_words(plain(F.col(f"{c}_t"))) for c in raw},
            "_refs": refs_in(F.concat_ws(" ", *[f"{c}_t" for c in raw])),
            "_after": descriptive_part(street_parts(F.col("_s_t"))),
        }
    ).drop(*[f"{c}_t" for c in raw])
    base = base.withColumns(
        {
            "_text": F.trim(F.regexp_replace(F.concat_ws(" ", "_s", "_a", "_b"), " +", " ")),
            "_after_title": road_title(F.col("_after")),
            "_street_title": road_title(F.col("_s")),
            "_node": F.when(F.col("_b") != "", F.col("_b")).otherwise(F.col("_a")),
        }
    )
    base = stage(base, "road-texts")

    alias = best_contained(
        base, "_text", lookups.aliases, "key", F.struct("priority", F.length("key"), "key"),
        ["key", "corridor_norm", "corridor_group", "road_scope"],
    ).select("_text", F.struct("key", "corridor_norm", "corridor_group", "road_scope").alias("_alias"))

    meta = ["name", "road_type", "length_km", "departments"]
    combos = base.select("_refs").distinct().select("_refs", F.posexplode("_refs").alias("_pos", "key"))
    ref_hit = combos.join(lookups.refs, "key").groupBy("_refs").agg(
        F.min(F.struct("_pos", "key", *meta)).alias("_ref")
    )
    named = lookups.names.select("key", F.struct(*meta).alias("_hit"))
    df = (
        base.join(alias, "_text", "left")
        .join(ref_hit, "_refs", "left")
        .join(named.select(F.col("key").alias("_after"), F.col("_hit").alias("_after_hit")), "_after", "left")
        .join(named.select(F.col("key").alias("_s"), F.col("_hit").alias("_street_hit")), "_s", "left")
        .withColumns(
            {
                "_rule": rule_match(F.col("_text"), F.col("_refs")),
                "_shown_ref": format_ref(F.col("_ref.key")),
                "_ref_bare": is_ref_like(traffic_compact(F.col("_ref.name"))),
                "_node_title": road_title(F.col("_node")),
            }
        )
    )
    alias_ok = F.col("_alias.corridor_norm") != ""
    after_named = (F.col("_after") != "") & ~is_ref_like(F.col("_after"))
    ref_bare = F.col("_ref").isNotNull() & F.col("_ref_bare") & after_named
    street_ok = ~F.col("_s").isin(*GENERIC_STREETS)
    node_ok = ~F.col("_node").isin(*GENERIC_STREETS)
    no_meta = F.struct(
        F.lit("").alias("road_type"), F.lit(None).cast("double").alias("length_km"), F.lit("").alias("departments")
    )

    def meta_of(hit: str) -> Column:
        h = F.col(hit)
        return F.struct(h["road_type"].alias("road_type"), h["length_km"].alias("length_km"),
                        h["departments"].alias("departments"))

    def answer(candidate, corridor, method, confidence, detail, meta=no_meta, local=None) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            as_col(candidate).alias("candidate"), as_col(corridor).alias("corridor"), as_col(method).alias("method"),
            as_col(confidence).alias("confidence"), as_col(detail).alias("detail"), meta.alias("meta"),
            (F.col("_street_title") if local is None else local).alias("local"),
        )

    shown_ref = F.col("_shown_ref")
    result = (
        F.when((F.col("_s") == "") & (F.col("_a") == "") & (F.col("_b") == ""), F.lit(None))
        .when(
            F.col("_rule").isNotNull(),
            answer(F.col("_rule.norm"), F.col("_rule.norm"), F.col("_rule.method"), "HIGH", "CORRIDOR_RULE_OR_REF_ALIAS"),
        )
        .when(
            alias_ok,
            answer(F.col("_alias.corridor_norm"), F.col("_alias.corridor_norm"), "TEXT_ALIAS_TABLE", "HIGH",
                   F.concat(F.lit("ALIAS_TABLE:"), F.col("_alias.key"))),
        )
        .when(
            ref_bare & F.col("_after_hit").isNotNull(),
            answer(shown_ref, F.col("_after_hit.name"), "OSM_NAME", "HIGH",
                   F.concat(F.lit("REF_WITH_OSM_NAME:"), shown_ref), meta_of("_after_hit")),
        )
        .when(
            ref_bare,
            answer(shown_ref, F.col("_after_title"), "REF_TEXT_NAME", "HIGH",
                   F.concat(F.lit("REF_WITH_TEXT_NAME:"), shown_ref), meta_of("_ref")),
        )
        .when(
            F.col("_ref").isNotNull(),
            answer(shown_ref, F.col("_ref.name"), "OSM_REF", "HIGH", "OSM_REF_LOOKUP", meta_of("_ref")),
        )
        .when(
            F.col("_after_hit").isNotNull(),
            answer(F.col("_after_hit.name"), F.col("_after_hit.name"), "OSM_NAME", "HIGH",
                   "ROAD_NAME_AFTER_REF_OSM_NAME", meta_of("_after_hit")),
        )
        .when(
            F.col("_after") != "",
            answer(F.col("_after_title"), F.col("_after_title"), "TEXT_STREET", "MEDIUM",
                   "ROAD_NAME_AFTER_REF_TEXT"),
        )
        .when(
            street_ok & F.col("_street_hit").isNotNull(),
            answer(F.col("_street_hit.name"), F.col("_street_hit.name"), "OSM_NAME", "HIGH", "OSM_NAME_EXACT",
                   meta_of("_street_hit")),
        )
        .when(
            street_ok,
            answer(F.col("_street_title"), F.col("_street_title"), "TEXT_STREET",
                   F.when(F.col("has_city"), "MEDIUM").otherwise("LOW"), "TEXT_STREET_NO_OSM_EXACT"),
        )
        .when(
            node_ok,
            answer(F.col("_node_title"), F.col("_node_title"), "NODE_CONTEXT", "LOW", "NODE_CONTEXT_AS_LAST_RESORT",
                   local=F.col("_node_title")),
        )
    )
    by_alias = (F.col("_r.method") == "TEXT_ALIAS_TABLE")
    reason = F.when((F.col("_s") == "") & (F.col("_a") == "") & (F.col("_b") == ""), "NO_STREET_OR_NODE_TEXT").otherwise(
        "GENERIC_OR_EMPTY_ROAD_TEXT"
    )
    group = corridor_group(F.col("_name"), F.col("_r.method"), F.col("_refs"),
                           F.when(by_alias, F.col("_alias.corridor_group")))
    hit = F.col("_r").isNotNull()

    def or_unresolved(col: Column, fallback="UNRESOLVED") -> Column:
        return F.when(hit, col).otherwise(fallback)

    out = df.withColumn("_r", result).withColumn("_name", traffic_compact(F.col("_r.corridor")))
    out = out.withColumn("_group", group)
    return out.select(
        *key,
        or_unresolved(F.col("_r.candidate"), "").alias("corridor_candidate"),
        or_unresolved(F.col("_r.corridor"), "").alias("corridor_norm"),
        or_unresolved(F.col("_r.local"), "").alias("corridor_local_name"),
        or_unresolved(F.col("_group")).alias("corridor_group"),
        or_unresolved(road_scope(F.col("_group"), F.when(by_alias, F.col("_alias.road_scope")))).alias("road_scope"),
        or_unresolved(F.col("_r.method")).alias("corridor_match_method"),
        or_unresolved(F.col("_r.confidence")).alias("corridor_match_confidence"),
        F.when(hit, "RESOLVED").otherwise("UNRESOLVED").alias("corridor_match_status"),
        F.when(hit, "").otherwise(reason).alias("unresolved_reason"),
        F.when(hit, F.col("_r.detail")).otherwise(reason).alias("corridor_resolution_detail"),
        F.when(hit, F.col("_r.meta.road_type")).otherwise("").alias("catalog_road_type"),
        F.when(hit, F.col("_r.meta.length_km")).alias("catalog_length_km"),
        F.when(hit, F.col("_r.meta.departments")).otherwise("").alias("catalog_departments"),
    )


def resolve_traffic(df: DataFrame, lookups: Lookups, street: str = "street_modal", start: str | None = "start_node_modal",
                    end: str | None = "end_node_modal", city: str = "city_modal") -> DataFrame:
    """Rows with their corridor. Works on the distinct texts and joins back."""
    parts = {
        "street": text_or_blank(F.col(street)),
        "start_node": text_or_blank(F.col(start)) if start else F.lit(""),
        "end_node": text_or_blank(F.col(end)) if end else F.lit(""),
        "has_city": traffic_compact(F.col(city)) != "",
    }
    keyed = df.withColumns({f"_k_{name}": col for name, col in parts.items()})
    texts = keyed.select(*[F.col(f"_k_{name}").alias(name) for name in parts])
    resolved = resolve_texts(texts, lookups)
    resolved = resolved.select(*[F.col(name).alias(f"_k_{name}") for name in parts], *RESOLVED_COLUMNS)
    out = keyed.join(resolved, [f"_k_{name}" for name in parts], "left").drop(*[f"_k_{name}" for name in parts])
    return with_confidence(out)


def with_confidence(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "corridor_match_confidence_score": lookup(F.col("corridor_match_confidence"), CONFIDENCE_SCORES, 0.0),
            "corridor_norm_group": F.coalesce(F.nullif(F.col("corridor_norm"), F.lit("")), F.lit("UNRESOLVED")),
        }
    )


# --- incidents ---------------------------------------------------------------


def _phrase_rule(padded: Column, which: int, rules=INCIDENT_RULES) -> Column:
    """Corridor of the first rule with one of its references (1) or aliases (2) as whole words.

    ``padded`` is a stored column of compact text between blanks: it is named once per phrase.
    """
    chain = F.when(F.lit(False), "")
    for rule in rules:
        for phrase in rule[which]:
            chain = chain.when(padded.contains(f" {phrase} "), rule[0])
    return chain


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), compact_text(text), F.lit(" "))


def resolve_incident(df: DataFrame) -> DataFrame:
    """Reconcile text corridor and nearest-road corridor of incidents."""
    rule_names = [r[0] for r in INCIDENT_RULES]
    joined = lambda *names: F.concat_ws(" ", *[text_or_blank(F.col(n)) for n in names])
    df = df.withColumns(
        {
            "_told": compact_text(joined("address", "observation")),
            "_roads": compact_text(joined("corridor_candidate", "road_name_candidates")),
            "_rref": _padded(F.col("nearest_osm_ref")),
            "_rname": _padded(F.col("nearest_osm_name")),
            "_key": compact_text(F.col("corridor_candidate")),
        }
    )
    # the long text is compacted once; only a tag that begins in one part and ends in another makes the whole differ from its parts
    split_tag = joined("corridor_candidate", "road_name_candidates").rlike("[<>]")
    whole = lambda parts, *names: F.when(split_tag, _padded(joined(*names))).otherwise(
        F.concat(F.lit(" "), F.trim(F.concat_ws(" ", *parts)), F.lit(" ")))
    df = df.withColumns(
        {
            "_full": whole(("_roads", "_told"), "corridor_candidate", "road_name_candidates", "address", "observation"),
            "_ctx": whole(("_told", "_key"), "address", "observation", "corridor_candidate"),
        }
    )
    df = df.withColumns(
        {
            "_ruled": F.coalesce(_phrase_rule(F.col("_full"), 1), _phrase_rule(F.col("_full"), 2)),
            "_by_ref": _phrase_rule(F.col("_rref"), 1),
            "_by_name": _phrase_rule(F.col("_rname"), 2),
        }
    )
    df = df.withColumns(
        {
            "_t": F.struct(
                F.coalesce("_ruled", title_case(F.col("_key"))).alias("norm"),
                F.when(F.col("_ruled").isNotNull(), "TEXT_ALIAS")
                .when(F.col("_key").isin(*KNOWN_CORRIDORS), "MANUAL_RULE")
                .when(nonempty(F.col("corridor_candidate")), "TEXT_ALIAS")
                .otherwise("UNRESOLVED").alias("source")),
            "_o": F.struct(
                F.coalesce("_by_ref", "_by_name", title_case(F.trim("_rname"))).alias("norm"),
                F.when(F.col("_by_ref").isNotNull(), "OSM_REF").when(F.trim("_rname") != "", "OSM_NAME")
                .otherwise("UNRESOLVED").alias("source")),
        }
    ).withColumn("_text_key", compact_text(F.col("_t.norm")))
    text, road = F.col("_t.norm"), F.col("_o.norm")
    text_source, road_source = F.col("_t.source"), F.col("_o.source")
    has_text, has_road_norm = text != "", road != ""
    has_road = nonempty(F.col("nearest_osm_name")) | nonempty(F.col("nearest_osm_ref"))
    near = has_text & has_road & F.col("osm_match_status").isin("SPATIAL_OSM_HIGH", "SPATIAL_OSM_MEDIUM")
    crossing = (text_or_blank(F.col("intersection_candidate")) != "") | F.col("_ctx").contains(" interseccion ") | F.col(
        "_ctx").contains(" y ")
    text_key = F.col("_text_key")
    strong = (
        (text_source == "MANUAL_RULE")
        | text_key.isin(*KNOWN_CORRIDORS)
        | text_key.isin(*[_plain(n) for n in rule_names])
    )
    equal = has_text & (text == road)
    local = near & (F.col("nearest_osm_distance_m") <= 50) & strong
    from_road = has_road_norm & (road_source != "UNRESOLVED")
    resolution = (
        F.when(equal, "COMPATIBLE")
        .when(near & crossing, "INTERSECTION_ACCEPTED")
        .when(local, "LOCAL_NAME_WITHIN_CORRIDOR")
        .when(near, "REVIEW_COORDINATE_OR_NAME")
        .when(from_road, F.when(has_text, "REVIEW_COORDINATE_OR_NAME").otherwise("COMPATIBLE"))
        .otherwise("UNRESOLVED")
    )
    return df.withColumns(
        {
            "corridor_norm": F.when(equal | near, text).when(from_road, road).otherwise(text),
            "corridor_norm_source": F.when(
                equal, F.when(road_source.isin("OSM_REF", "OSM_NAME"), road_source).otherwise(text_source)
            )
            .when(near, text_source)
            .when(from_road, road_source)
            .when(has_text, text_source)
            .otherwise("UNRESOLVED"),
            "text_osm_resolution": resolution,
            "corridor_resolution_confidence": F.when(
                equal, F.when(F.col("osm_match_status") == "SPATIAL_OSM_HIGH", "HIGH").otherwise("MEDIUM")
            )
            .when((near & crossing) | local, "MEDIUM")
            .when(near, "LOW")
            .when(from_road, "MEDIUM")
            .otherwise("LOW"),
            "nearest_osm_corridor_norm": F.when(equal | near | (road_source != "UNRESOLVED"), road).otherwise(""),
            "text_corridor_norm": text,
        }
    ).drop("_t", "_o", "_full", "_ctx", "_rref", "_rname", "_key", "_ruled", "_by_ref", "_by_name", "_text_key", "_told", "_roads")


def _plain(text: str) -> str:
    import unicodedata

    flat = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in flat).split())
