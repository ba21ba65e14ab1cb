"""Line deduplication by pairwise alignment.

Documents that overlap are found by what they share. A line of ``floor`` words or
more that at most ``rare`` documents hold leads each of them to the first. So that
common lines lose nothing, lines are also hashed together with their neighbours
until ``least`` words are reached, once forward and once backward (a line of that
many words by itself), and every such run, however many hold it, leads to its first
holder: a run that thousands share costs a pair for each, not pairs among them. Two
partners are aligned by patience diff: lines that are unique on both sides and in
order are anchors, anchors grow over equal neighbours, and the gaps between them are
aligned in turn. If the aligned blocks of at least ``floor`` words hold ``least``
words together, they are deleted from the later document. Runs that stand in another
order in the earlier document, which no alignment can hold, are deleted after that.

So a line goes if it lies in an aligned block of a partner, or is part of a stretch
of at least ``least`` words that an earlier document holds line by line anywhere.

Rules: lines are compared without outer white space, lines without a word are
skipped and stay; the earlier document is the one with the smaller id, null ids
are last, rows of one id are ordered by their text, rows of one id and text are
one document; null text has no lines; a text of any length is one row; texts
without a common run stay as they are; an empty table gives an empty result;
other columns are ignored or, in ``without_repeats``, kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import discard, order_key, slices, stage, texts
from corridor_spark.llm.secrets import let

#: Words that common blocks must have together: a line of that many is enough by itself.
LEAST = 8
#: Words that each aligned block must have.
FLOOR = 3
#: Documents that may hold a line which leads to partners by itself.
RARE = 16


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """(place, hash, words) of each line with a word."""
    place, names, words = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        if n := len(line.split()):
            place.append(i)
            names.append(xxhash.xxh3_64_intdigest(line.strip()) - 2**63)
            words.append(n)
    return place, names, words


def runs(names: list[int], words: list[int], least: int) -> dict[tuple[int, int], int]:
    """(first, end) and hash of the shortest runs of ``least`` words that begin, or end, at each line."""
    out, total, end = {}, 0, 0
    for first in range(len(names)):
        while end < len(names) and total < least:
            total, end = total + words[end], end + 1
        if total < least:
            break
        out[first, end] = hash(tuple(names[first:end]))
        total -= words[first]
    total, first = 0, len(names)
    for end in range(len(names), 0, -1):
        while first and total < least:
            first, total = first - 1, total + words[first - 1]
        if total < least:
            break
        out[first, end] = hash(tuple(names[first:end]))
        total -= words[end - 1]
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal elements, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        once = [{x for x, n in Counter(s).items() if n == 1} for s in (a[a0:a1], b[b0:b1])]
        there = {b[j]: j for j in range(b0, b1) if b[j] in once[1]}
        ends, tops, back = [], [], {}  # longest rising sequence of places in b
        for i in range(a0, a1):
            if a[i] in once[0] and a[i] in there:
                j = there[a[i]]
                k = bisect_left(tops, j)
                back[i] = ends[k - 1] if k else None
                tops[k : k + 1], ends[k : k + 1] = [j], [i]
        chain, i = [], ends[-1] if ends else None
        while i is not None:
            chain.append((i, there[a[i]]))
            i = back[i]
        low_a, low_b = a0, b0
        for i, j in reversed(chain):
            if i < low_a or j < low_b:  # an earlier anchor has grown over it
                continue
            x, y = i, j
            while x > low_a and y > low_b and a[x - 1] == b[y - 1]:
                x, y = x - 1, y - 1
            if x > low_a and y > low_b:
                todo.append((low_a, x, low_b, y))
            while i < a1 and j < b1 and a[i] == b[j]:
                i, j = i + 1, j + 1
            out += [(x + k, y + k) for k in range(i - x)]
            low_a, low_b = i, j
        if chain:
            todo.append((low_a, a1, low_b, b1))
    return sorted(out)


def aligned_blocks(a: list[int], words: list[int], b: list[int], floor: int) -> list[range]:
    """Blocks of ``a`` of at least ``floor`` words that the alignment holds."""
    out, block = [], []
    for pair in [*patience(a, b), (-1, -1)]:
        if block and pair != (block[-1][0] + 1, block[-1][1] + 1):
            lines = range(block[0][0], block[-1][0] + 1)
            if sum(words[i] for i in lines) >= floor:
                out.append(lines)
            block = []
        block.append(pair)
    return out


def repeated(later: tuple[list[int], list[int]], earlier: tuple[list[int], list[int]], least: int = LEAST, floor: int = FLOOR) -> list[int]:
    """Lines of the later document (numbers among those with a word) that go; each side is (hashes, words)."""
    (a, words), (b, _) = later, earlier
    gone = {i for block in aligned_blocks(a, words, b, floor) for i in block}
    if sum(words[i] for i in gone) < least:
        gone = set()
    held = set(runs(b, earlier[1], least).values())
    for (first, end), name in runs(a, words, least).items():
        if name in held:  # moved, or repeated within a document
            gone.update(range(first, end))
    return sorted(gone)


def removals(docs: DataFrame, least: int = LEAST, floor: int = FLOOR, rare: int = RARE) -> DataFrame:
    """Per document with repeats: key, gone (the places of the lines to delete) and the partners that hold them."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [lines_of(t) for t in part.column("text").to_pylist()]
            found = [list(set(runs(r[1], r[2], least).values())) for r in rows]
            single = [list({h for h, n in zip(r[1], r[2]) if floor <= n < least}) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), *(pa.array([r[k] for r in rows], pa.list_(t)) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32()))),
                 *(pa.array(x, pa.list_(pa.int64())) for x in (found, single))], ["key", "place", "names", "words", "runs", "lines"])

    key = "struct<none:boolean,id:bigint,text:bigint>"
    lines = stage(texts(docs).select(order_key().alias("key"), "text").mapInArrow(
        split, f"key {key}, place array<int>, names array<long>, words array<int>, runs array<long>, lines array<long>"), "lines")
    held = lines.select("key", F.explode("runs").alias("run"), F.lit(False).alias("line")).unionByName(
        lines.select("key", F.explode("lines").alias("run"), F.lit(True).alias("line")))
    first = (held.groupBy("run", "line").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("times"))
             .where(F.col("first") != F.col("last")).where(~F.col("line") | (F.col("times") <= rare)))
    pairs = stage(held.join(first.select("run", "line", "first"), ["run", "line"]).where("key <> first").select("key", "first").distinct(), "pairs")
    side = lambda name, *more: lines.dropDuplicates(["key"]).select(
        F.col("key").alias(name), *more, F.col("names").alias(f"{name}_names"), F.col("words").alias(f"{name}_words"))
    both = (pairs.join(side("first").join(pairs.select("first").distinct(), "first", "leftsemi"), "first")
            .join(side("key", "place").join(pairs.select("key").distinct(), "key", "leftsemi"), "key"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("place", "key_names", "key_words", "first_names", "first_words")]
            gone = [[p[i] for i in repeated((a, x), (b, y), least, floor)] for p, a, x, b, y in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(gone, pa.list_(pa.int32()))], ["key", "gone"])

    aligned = both.select("key", "place", "key_names", "key_words", "first_names", "first_words").mapInArrow(align, f"key {key}, gone array<int>").where(F.size("gone") > 0)
    # a document has at most as many partners as runs and lines, so the lists stay as small as the document
    gone = stage(aligned.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"),
                                            F.count("*").alias("partners")), "gone")
    discard(lines, pairs)
    return gone


def _cleaned(docs: DataFrame, least: int) -> DataFrame:
    """``row``, the row of ``docs``, its ``text`` without the lines, and gone and partners (null without a repeat)."""
    gone = removals(docs, least)
    keyed = docs.select(order_key().alias("key"), F.struct("*").alias("row")).join(gone.hint("merge"), "key", "left")
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    cleaned = let(F.split("row.text", "\n", -1), lambda lines: F.array_join(kept(lines), "\n"))
    return keyed.withColumn("text", F.when(F.col("gone").isNotNull(), cleaned).otherwise(F.col("row.text")))


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_removed lines, the removed lines' places (joined), partners, and the text that is left."""
    done = _cleaned(docs.select("doc_id", "text"), least)
    places = F.array_join(F.transform(F.array_sort("gone"), lambda i: i.cast("string")), ",")
    return done.select("row.doc_id", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
                       F.coalesce(places, F.lit("")).alias("removed_lines"), F.coalesce("partners", F.lit(0)).cast("long").alias("partners"),
                       F.coalesce("text", F.lit("")).alias("text"))


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the repeated lines; a document that has lost its last word goes. ``n_chars``, where it is one, is counted anew."""
    done = _cleaned(docs, least).where(F.col("gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        counted = F.when(F.col("gone").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        row = row.withField("n_chars", F.coalesce(counted, F.col("row.n_chars")))
    return done.select(row.alias("row")).select("row.*")
