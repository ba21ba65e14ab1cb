"""Text normalisation as column expressions.

Two families: *incident* text drops HTML tags and keeps letters, digits and
blanks; *traffic* text keeps ``/ . _ -`` so that route references survive.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor_spark.lexicons import CATALOG_WORDS, ROAD_WORDS, ROUTE_PREFIXES, TITLE_SMALL_WORDS, TRAFFIC_SMALL_WORDS

MISSING_WORDS = ("", "nan", "none", "null", "na", "n/a")
_SPACES = r"[\s\p{Z}\x1c-\x1f\x85]+"


@functools.cache
def _folding() -> tuple[str, str, tuple[tuple[str, str], ...], str]:
    """Compatibility decomposition of lower-case characters, derived from Unicode data.

    Returns the one-to-one pairs for ``translate``, the one-to-many
    replacements whose result holds an ASCII character, and the class of
    combining marks. Other characters need no entry: every consumer turns
    non-ASCII into a blank.
    """
    single_from, single_to, several, marks = [], [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xAC00 <= code <= 0xD7A3:
            continue
        if unicodedata.combining(char):
            marks.append(code)
            continue
        if char.lower() != char:
            continue
        flat = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if not flat:  # made of marks alone
            several.append((char, flat))
            continue
        if flat == char or not any(c.isascii() for c in flat):
            continue
        if len(flat) == 1:
            single_from.append(char)
            single_to.append(flat)
        else:
            several.append((char, flat))
    ranges, start = [], marks[0]
    for prev, here in zip(marks, marks[1:] + [None]):
        if here != prev + 1:
            ranges.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
            start = here
    # The look-ahead settles most characters by their category before the long class is tried; the JVM may not know the newest marks.
    return "".join(single_from), "".join(single_to), tuple(several), r"(?=[\p{M}\p{Cn}])[" + "".join(ranges) + "]+"


def _char_class(chars: list[str]) -> str:
    """Regular-expression class of the characters, with runs as ranges."""
    codes = sorted(map(ord, chars))
    out, start = [], codes[0]
    for prev, here in zip(codes, codes[1:] + [None]):
        if here != prev + 1:
            out.append(rf"\x{{{start:x}}}-\x{{{prev:x}}}")
            start = here
    return "[" + "".join(out) + "]"


def fold(col: Column) -> Column:
    """Lower case without accents or compatibility forms (``É`` → ``e``, ``ª`` → ``a``, ``㎞`` → ``km``).

    Forms of several characters are looked up one by one, in rows that hold one.
    """
    single_from, single_to, several, marks = _folding()
    low = F.lower(col)
    out = F.translate(low, single_from, single_to)
    expansions = F.create_map(*[F.lit(x) for pair in several for x in pair])
    spelled = F.array_join(F.transform(F.regexp_extract_all(out, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(expansions[c], c)), "")
    # the look-ahead passes over ASCII before the long class is tried, as that of the marks does
    out = F.when(out.rlike(r"(?=[^\x00-\x7f])" + _char_class([char for char, _ in several])), spelled).otherwise(out)
    is_ascii = F.octet_length(low) == F.length(low)
    return F.when(is_ascii, low).otherwise(F.regexp_replace(out, marks, ""))


def fold_exact(col: Column) -> Column:
    """``fold`` for every compatibility form Unicode lists, at the price of an Arrow UDF."""
    @F.pandas_udf("string")
    def nfkd(values: pd.Series) -> pd.Series:
        flat = values.str.lower().str.normalize("NFKD")
        return flat.map(lambda text: "".join(c for c in text if not unicodedata.combining(c)), na_action="ignore")

    return nfkd(col)


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, _SPACES, " "))


def text_or_blank(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def plain(text: Column) -> Column:
    """Compact form of text that is already folded. ``fold`` names its input several
    times, so longer chains fold a stored column once and go on from there."""
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


# --- incident family ---------------------------------------------------------


def normalize_text(col: Column) -> Column:
    """Lower, accents and tags removed, blanks squeezed; null becomes blank."""
    return squeeze(F.regexp_replace(fold(text_or_blank(col)), "<[^>]+>", " "))


def compact_text(col: Column) -> Column:
    """``normalize_text`` with only ``a-z 0-9`` and single blanks left."""
    return F.trim(
        F.regexp_replace(F.regexp_replace(fold(text_or_blank(col)), "<[^>]+>", " "), "[^a-z0-9]+", " ")
    )


def catalog_text(col: Column) -> Column:
    """Road catalogue key: incident text with the catalogue's word replacements."""
    out = normalize_text(col)
    for pattern, word in CATALOG_WORDS:
        out = F.regexp_replace(out, pattern, word)
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def network_text(col: Column) -> Column:
    """Road network key: accents and ordinals removed, no tag rule."""
    return F.trim(F.regexp_replace(fold(text_or_blank(col)), "[^a-z0-9]+", " "))


# --- traffic family ----------------------------------------------------------


def traffic_text(col: Column) -> Column:
    """Lower, accents removed, dashes unified, only ``a-z 0-9 / . _ -`` and blanks left."""
    out = F.regexp_replace(fold(text_or_blank(col)), r"[‐-―]", "-")
    return squeeze(F.regexp_replace(out, "[^a-z0-9/ ._-]+", " "))


def traffic_compact(col: Column) -> Column:
    return F.trim(F.regexp_replace(fold(text_or_blank(col)), "[^a-z0-9]+", " "))


def expand_road_words(col: Column) -> Column:
    """Whole-word road abbreviations spelled out (``av`` → ``avenida``)."""
    for words, full in ROAD_WORDS:
        col = F.regexp_replace(col, rf"\b(?:{'|'.join(words)})\b", full)
    return col


def road_text(col: Column) -> Column:
    """Compact traffic text with road abbreviations spelled out."""
    return expand_road_words(traffic_compact(col))


def key_text(col: Column) -> Column:
    """Window key: the compact form without the tag rule."""
    return network_text(col)


# --- titles and slugs --------------------------------------------------------


def title_case(compact: Column, small: tuple[str, ...] = TITLE_SMALL_WORDS) -> Column:
    """Capitalise each word of compact text except small words after the first."""
    words = F.split(compact, " ")
    return F.array_join(
        F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.initcap(w))), " "
    )


def road_title(compact: Column) -> Column:
    """Title of traffic text: route prefixes and the number after one are upper case."""
    words = F.split(compact, " ")

    def one(word: Column, i: Column) -> Column:
        after_prefix = (i > 0) & F.get(words, i - 1).isin(*ROUTE_PREFIXES)
        return (
            F.when((i > 0) & word.isin(*TRAFFIC_SMALL_WORDS), word)
            .when(word.isin(*ROUTE_PREFIXES), F.upper(word))
            .when(after_prefix & word.rlike("^[0-9]{1,3}[a-z]?$"), F.upper(word))
            .otherwise(F.initcap(word))
        )

    return F.array_join(F.transform(words, one), " ")


def slug(col: Column) -> Column:
    return F.replace(compact_text(col), F.lit(" "), F.lit("_"))


# --- predicates --------------------------------------------------------------


def nonempty(col: Column) -> Column:
    """True unless null, blank or one of the written forms of missing."""
    return F.coalesce(~F.lower(F.trim(col.cast("string"))).isin(*MISSING_WORDS), F.lit(False))


def contains_any(text: Column, terms) -> Column:
    """True when any of the plain terms occurs in the text (plain searches; an alternation would try every term everywhere)."""
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def has_phrase(text: Column, phrase: str) -> Column:
    """True when the phrase occurs as whole words in compact text."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {phrase} ")


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def corridor_key(col: Column) -> Column:
    """Join key of a corridor name: compact text, or ``unresolved`` when blank."""
    key = traffic_compact(col)
    return F.when(key == "", "unresolved").otherwise(key)


def clean_corridor(col: Column, fallback: str = "UNRESOLVED") -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(fallback))


def label(col: Column, labels: dict[str, str], missing: str = "Sin dato") -> Column:
    """Shown label of a code; an unlisted code is title-cased with blanks."""
    if not labels:
        named = F.lit(None).cast("string")
    else:
        named = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[col]
    return F.when(col.isNull(), missing).otherwise(F.coalesce(named, F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))))


def lookup(col: Column, table: dict, default) -> Column:
    """Value of a small fixed table for a key column."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[col], F.lit(default))
