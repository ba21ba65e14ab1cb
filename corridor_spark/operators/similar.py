"""Candidates of a text similarity join, from exact indexes instead of all pairs.

The similarity is ``share`` parts sequence ratio and the rest word Jaccard, or
what containment says. A pair that reaches ``keep`` is found one of three ways:

* one text lies inside the other: the containment join;
* the texts share a word: an equality join on words, in which a pair counts for
  its rarest shared word alone;
* they share none, so the ratio itself is at least ``keep / share``. The matched
  characters are then at least that share of both texts' mean length, which
  bounds the lengths and how many characters (with their number of occurrence)
  both have. With all characters ordered from rare to frequent, the first few of
  both texts must have two in common (one, in texts of more than ``LONG``): an
  equality join on pairs of them.

Before a pair leaves the join, the common characters bound the whole score from
above, as column expressions; what stays is what has to be compared in full.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.operators.contains import contained_keys
from corridor_spark.session import small_side, stage

#: Texts up to this length are indexed by pairs of rare characters, longer ones by single ones.
LONG = 64


def _tokens(texts: DataFrame, text: str) -> DataFrame:
    """Distinct texts with their characters, each with the number of its occurrence, and their distinct words."""
    letters = texts.select(F.col(text).alias("text")).where("text != ''").distinct().withColumn("letters", F.array_sort(F.split("text", "")))
    numbered = F.transform("letters", lambda c, i: F.concat(c, (i - F.array_position("letters", c)).cast("string")))
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return stage(letters.select("text", numbered.alias("mark"), words.alias("word")), "similar-texts")


def _rarity(texts: list[DataFrame], name: str) -> DataFrame:
    """A rank for each character or word of the texts, rare ones first."""
    counted = texts[0].unionByName(texts[1]).select(F.explode(name).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.select(name, F.struct("n", name).alias("rank")), "similar-ranks")


def _profiles(texts: DataFrame, ranks: dict[str, DataFrame]) -> DataFrame:
    """Per text its length, its characters and its words, as hashes from rare to frequent."""
    out = texts.select("text", F.length("text").alias("size"))
    for name, ranked in ranks.items():
        rows = texts.select("text", F.explode(name).alias(name)).join(small_side(ranked), name)
        ordered = rows.groupBy("text").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))  # as many as the text has
        out = out.join(ordered.select("text", F.transform("ranks", lambda r: F.xxhash64(r)).alias(name)), "text", "left")
    return stage(out, "similar-profiles")


def candidates(left: DataFrame, right: DataFrame, keep: float, share: float = 0.7, a: str = "name", b: str = "alias") -> DataFrame:
    """Distinct pairs (``a``, ``b``) of the texts of two tables that can score ``keep``; no pair that does is missing.

    Null and empty texts pair with nothing; repeated texts count once.
    """
    left, right = _tokens(left, a), _tokens(right, b)
    ranks = {name: _rarity([left, right], name) for name in ("mark", "word")}
    one, two = _profiles(left, ranks), _profiles(right, ranks)

    def meet(keys) -> DataFrame:
        x, y = (p.select(F.explode(keys(F.col("size"), F.col("mark"), F.col("word"))).alias("key"), *(F.col(c).alias(f"{c}_{s}") for c in p.columns))
                for p, s in ((one, "x"), (two, "y")))
        return x.join(y, "key").where((F.instr("text_x", F.col("text_y")) == 0) & (F.instr("text_y", F.col("text_x")) == 0))

    common = F.array_intersect("word_x", "word_y")
    total, shared = F.col("size_x") + F.col("size_y"), F.size(common)
    in_length = 2.0 * F.least("size_x", "size_y") / total
    in_marks = 2.0 * F.size(F.array_intersect("mark_x", "mark_y")) / total
    jaccard = shared / (F.size("word_x") + F.size("word_y") - shared)
    goal = keep - 1e-4  # scores are rounded to four digits
    by_word = meet(lambda size, mark, word: word).where(
        (F.get(common, F.lit(0)) == F.col("key")) & (share * in_length + (1 - share) * jaccard >= goal)
        & (share * in_marks + (1 - share) * jaccard >= goal))
    lying = contained_keys(left.select(F.col("text").alias("text_x")), "text_x", right.select(F.col("text").alias("text_y")), "text_y")
    round_ = contained_keys(right.select(F.col("text").alias("text_y")), "text_y", left.select(F.col("text").alias("text_x")), "text_x")
    pair = ["text_x", "text_y"]
    found = by_word.select(*pair).unionByName(lying.select(*pair).unionByName(round_.select(*pair)).distinct())
    least = goal / share
    if least <= 1:  # a ratio alone can do
        part = least / (2 - least)  # of its characters that a text has in common with any that it matches, at least
        short = next(n for n in range(1, 1 << 20) if math.ceil(n * part - 1e-9) >= 2)  # from here on two are in common
        single = lambda size: (size > LONG) | (size < short)

        def rare(size: Column, mark: Column, word: Column) -> Column:
            head = lambda k: F.slice(mark, 1, F.greatest(size - F.ceil(size * part - 1e-9) + k, F.lit(0)).cast("int"))
            nothing = F.array().cast("array<array<bigint>>")
            pairs = F.flatten(F.transform(head(2), lambda p, i: F.transform(F.slice(head(2), i + 2, F.size(head(2))), lambda q: F.array(p, q))))
            ones = F.transform(head(1), lambda p: F.array(p))
            partner = (size >= math.floor(LONG * part)) | (size <= math.ceil(short / part))  # can meet a text that only has single keys
            return F.concat(F.when(single(size), nothing).otherwise(pairs), F.when(partner, ones).otherwise(nothing))

        alike = F.array_intersect("mark_x", "mark_y")
        first = F.slice(alike, 1, F.when(single(F.col("size_x")) | single(F.col("size_y")), 1).otherwise(2))
        by_marks = meet(rare).where((shared == 0) & (in_length >= least) & (F.col("key") == first) & (in_marks >= least))
        found = found.unionByName(by_marks.select(*pair))
    return found.select(F.col("text_x").alias(a), F.col("text_y").alias(b))
