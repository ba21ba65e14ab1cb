"""Route references such as ``CA-1`` or ``RN 05``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor_spark.functions.text import expand_road_words, plain, road_title, traffic_compact, traffic_text
from corridor_spark.lexicons import ROUTE_PREFIXES

_PREFIXES = "|".join(ROUTE_PREFIXES)
REF_PATTERN = rf"\b({_PREFIXES})\s*-?\s*0*([0-9]{{1,3}}[a-z]?)\b"
REF_WHOLE = rf"^({_PREFIXES})\s*0*([0-9]{{1,3}}[a-z]?)$"
REF_LIKE = rf"^({_PREFIXES})\s+[0-9]{{1,3}}[a-z]?$"


def normalize_ref(col: Column) -> Column:
    """``RN-05`` → ``rn 5``; other text stays compact."""
    return ref_of(traffic_compact(col))


def ref_of(compact: Column) -> Column:
    """``normalize_ref`` of compact text. The pattern keeps other text as it is."""
    return F.regexp_replace(compact, REF_WHOLE, "$1 $2")


def is_ref_like(compact: Column) -> Column:
    """True for compact text that is a whole reference."""
    return compact.rlike(REF_WHOLE)


def format_ref(ref: Column) -> Column:
    """Shown form of a normalised reference: ``rn 5`` → ``RN 5``."""
    return F.when(ref.rlike(r"^[a-z]+\s+[0-9]{1,3}[a-z]?$"), F.upper(ref)).otherwise(road_title(ref))


def refs_in(text: Column) -> Column:
    """Sorted distinct references of traffic text, as an array."""
    found = F.regexp_extract_all(text, F.lit(REF_PATTERN), F.lit(0))
    one = F.transform(found, lambda r: F.regexp_replace(r, REF_PATTERN, "$1 $2"))
    return F.array_sort(F.array_distinct(one))


def route_refs(*cols: Column) -> Column:
    """Sorted distinct references of one or more raw text columns, as an array."""
    return refs_in(F.concat_ws(" ", *[traffic_text(c) for c in cols]))


def street_parts(text: Column) -> Column:
    """Non-blank road texts of a ``/``-joined street in traffic text."""
    return F.filter(F.transform(F.split(text, "/"), lambda p: expand_road_words(plain(p))), lambda p: p != "")


def descriptive_part(parts: Column) -> Column:
    """First part without a reference, else the last; blank for fewer than two parts."""
    named = F.filter(parts, lambda p: ~p.rlike(REF_PATTERN))
    best = F.coalesce(F.get(named, F.lit(0)), F.element_at(parts, -1))
    return F.when(F.size(parts) >= 2, best).otherwise("")


def name_after_ref(street: Column) -> Column:
    """Descriptive part of a raw ``ref / name`` street, title-cased; blank without a slash."""
    return road_title(descriptive_part(street_parts(traffic_text(street))))


def ref_parts(ref: Column) -> Column:
    """Prefix, number and suffix of a normalised reference (blank parts when it is none)."""
    pattern = r"^([a-z]+)\s+([0-9]{1,3})([a-z]?)$"
    return F.struct(
        F.regexp_extract(ref, pattern, 1).alias("prefix"),
        F.regexp_extract(ref, pattern, 2).alias("number"),
        F.regexp_extract(ref, pattern, 3).alias("suffix"),
    )
