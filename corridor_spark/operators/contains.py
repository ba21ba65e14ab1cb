"""Which keys of a table occur inside which texts.

Runs on distinct texts. Each task builds one Aho-Corasick automaton from the
keys and reads each text once, whatever its length and the keys' lengths; only
pairs that match leave it. At most ``KEYS`` keys go to the tasks at a time: a
larger set is split by the keys' hash, and the texts are read once per part.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.session import small_side, stage

#: Most keys of one automaton; pairs that a task hands on at a time.
KEYS, PAIRS = 100_000, 10_000


def _search(texts: DataFrame, text: str, words: list[str]) -> DataFrame:
    """``text`` and ``_key`` for each of the (at most ``KEYS``) words in each text."""
    sent = texts.sparkSession.sparkContext.broadcast(words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sent.value:
            return
        known = ahocorasick.Automaton()
        for word in sent.value:
            known.add_word(word, word)
        known.make_automaton()
        held: tuple[list[str], list[str]] = ([], [])
        for batch in batches:
            for value in batch.column(0).to_pylist():
                inside = {word for _, word in known.iter(value)}
                held[0].extend([value] * len(inside))
                held[1].extend(sorted(inside))
                if len(held[0]) >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.string())], [text, "_key"])
                    held = ([], [])
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.string()), pa.array(held[1], pa.string())], [text, "_key"])

    return texts.mapInArrow(find, f"`{text}` string, `_key` string")


def contained_keys(texts: DataFrame, text: str, keys: DataFrame, key: str, most: int = KEYS) -> DataFrame:
    """Distinct texts with each key they contain and the key's other columns; null and empty texts and keys match nothing."""
    usable = keys.filter(F.length(key) > 0)
    words = stage(usable.select(F.col(key).cast("string").alias("word")).distinct(), "contained-keys")
    parts = max(1, -(-words.count() // most))
    if parts > 1:  # by hash a part can be a little larger than the mean
        parts *= 2
    distinct = texts.select(F.col(text).cast("string").alias(text)).filter(F.length(text) > 0).distinct()
    if parts > 1:
        distinct = stage(distinct, "contained-texts")
    found = None
    for part in range(parts):
        some = words.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part) if parts > 1 else words
        pairs = _search(distinct, text, [r["word"] for r in some.collect()])
        found = pairs if found is None else found.unionByName(pairs)
    side = small_side(usable)
    return found.join(side, found["_key"] == side[key]).select(found[text], *[side[c] for c in keys.columns])


def best_contained(texts: DataFrame, text: str, keys: DataFrame, key: str, rank: Column,
                   payload: list[str]) -> DataFrame:
    """Per distinct text the payload of the contained key with the largest rank."""
    hits = contained_keys(texts, text, keys, key)
    return hits.groupBy(text).agg(F.max_by(F.struct(*payload), rank).alias("_hit")).select(text, "_hit.*")
