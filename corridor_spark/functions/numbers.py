"""Numeric, time and JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor_spark.functions.text import contains_any, nonempty
from corridor_spark.lexicons import LOCAL_ZONE, NUMBER_WORDS


def rounded(col: Column | str, digits: int) -> Column:
    """Half-up rounding in which a value a hair below a tie counts as the tie.

    Scores are sums of rounded parts, so exact ties are common, and the last
    bit of a sum depends on the order of addition. The guard keeps the result
    the same for every partitioning.
    """
    return F.round((F.col(col) if isinstance(col, str) else col) + F.lit(1e-9), digits)


def number(col: Column) -> Column:
    """Double, or null for text that is no number, ``NaN`` included."""
    value = F.try_cast(col, "double") if hasattr(F, "try_cast") else col.try_cast("double")
    return F.when(~F.isnan(value), value)


def number_or(col: Column, fill: float = 0.0) -> Column:
    return F.coalesce(number(col), F.lit(float(fill)))


def safe_float(col: Column) -> Column:
    """Number of a text column; written forms of missing give null."""
    return F.when(nonempty(col), number(col))


def safe_divide(num: Column, den: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(number_or(num), number_or(den)), F.lit(float(fill)))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two decimals; 0 when the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(rounded(part.cast("double") / whole.cast("double") * 100, 2))


def text_bool(col: Column, words: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    return F.coalesce(F.lower(F.trim(col.cast("string"))).isin(*words), F.lit(False))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def max_number(col: Column) -> Column:
    """Largest number written in a text, 0 when there is none."""
    found = F.regexp_extract_all(F.coalesce(col.cast("string"), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, lambda n: n.cast("double"))), F.lit(0.0))


def count_near(text: Column, keyword: str, stems: tuple[str, ...]) -> Column:
    """Largest count written next to a keyword pattern, in digits or Spanish words.

    ``stems`` are plain parts one of which every keyword match holds; texts
    without any are settled without the patterns.
    """
    any_number = rf"(\d+|{'|'.join(NUMBER_WORDS)})"
    before = F.regexp_extract_all(text, F.lit(rf"{any_number}\s+(?:personas?\s+)?{keyword}"), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(rf"{keyword}\s+(?:a\s+)?{any_number}\s+(?:personas?)?"), F.lit(1))
    words = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    values = F.transform(
        F.concat(before, after), lambda t: F.coalesce(words[t].cast("bigint"), t.try_cast("bigint"))
    )
    zero = F.lit(0).cast("bigint")
    return F.when(contains_any(text, stems), F.coalesce(F.array_max(values), zero)).otherwise(zero)


# --- time --------------------------------------------------------------------


def to_local(ts: Column, dtype: str, zone: str = LOCAL_ZONE) -> Column:
    """Local wall-clock time (``timestamp_ntz``) of a UTC instant, text or zone-less UTC time."""
    if dtype == "timestamp_ntz":
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
    instant = ts if dtype == "timestamp" else F.try_to_timestamp(ts)
    return F.convert_timezone(F.current_timezone(), F.lit(zone), instant.cast("timestamp_ntz"))


def time_period(hour: Column) -> Column:
    """Named part of the day; null for a null hour."""
    return (
        F.when(hour.between(0, 5), "madrugada")
        .when(hour.between(6, 9), "pico_manana")
        .when(hour.between(10, 11), "media_manana")
        .when(hour.between(12, 13), "mediodia")
        .when(hour.between(14, 16), "tarde")
        .when(hour.between(17, 19), "pico_tarde")
        .when(hour.isNotNull(), "noche")
    )


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def minute_label(minute: Column) -> Column:
    return F.concat_ws(":", F.lpad((minute / 60).cast("int").cast("string"), 2, "0"),
                       F.lpad((minute % 60).cast("int").cast("string"), 2, "0"))


def distance_class(distance: Column, steps, beyond: str, missing: str) -> Column:
    """Label of a distance by right-closed upper bounds."""
    out = F.when(distance.isNull(), missing)
    for upper, name in steps:
        out = out.when(distance <= upper, name)
    return out.otherwise(beyond)
