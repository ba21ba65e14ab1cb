"""Spelling variants: words of the corpus that differ by one code point, and the more frequent form that each leads to.

Words are counted in batches inside the tasks and summed. Two words are near if
one insertion, deletion or replacement makes one of the other: then their common
prefix and suffix together reach the longer one's length less one. The
comparison is dense: a block holds words of one length L, and of L + 1, as padded
code-point matrices, one aligned to the left and one to the right, and the first
difference in each gives prefix and suffix of every pair of the block.

Blocks are those words that agree outside one piece. A word of length L is cut
into pieces of about ``PIECE`` code points; an edit touches one piece, so near
words share the rest of some piece, by which they are dealt out. A block of more
than ``LOT`` words is tiled: its words fall into lots by a hash, and every pair of
lots is a block of its own, so no task holds more than two lots of one block. A
pair that agrees outside several pieces is reported by the first of them.

Rules: a null text has no words, a null id counts as empty; rows repeat as they
come and count again; other columns are ignored; an empty table has no words; a
word of any length is compared whole; of near words with one count the first in
code-point order is the form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import slices, stage, texts
from corridor_spark.session import small_side

#: Shortest word, fewest occurrences, and how many times as frequent a form is as its variant.
SHORTEST, FEWEST, TIMES = 7, 2, 10
#: Code points of a piece; most pieces of a word; words of a lot; matrix cells compared at once.
PIECE, MOST_PIECES, LOT, CELLS = 4, 8, 512, 4_000_000
#: Distinct words that a task gathers before it hands on their counts.
HELD = 200_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def word_counts(docs: DataFrame, alter: Callable[[int | None, str], str] | None = None, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """``word, n``: runs of letters in lower case (A-Z only), of ``shortest`` code points and ``fewest`` occurrences at least.

    ``alter`` may change a document's run before it is counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes: A-Z alone
                    word = alter(doc_id, run) if alter else run
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    some = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def pieces(size: int) -> np.ndarray:
    """Bounds of the pieces of a word of ``size`` code points."""
    count = min(MOST_PIECES, max(3, -(-size // PIECE)))
    return np.arange(count + 1) * size // count


def dealt(words: DataFrame) -> DataFrame:
    """A row per word and piece left out: as a word of its own length (``role`` 0), and as the longer of two lengths (1)."""
    sized = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("role")).select(
        "*", (F.length("word") - F.col("role")).alias("size")).where("size > 0 and (role = 0 or size >= 1)")
    count = f"least({MOST_PIECES}, greatest(3, cast(ceil(size / {PIECE}) as int)))"
    cut = sized.select("*", F.expr(f"explode(sequence(0, {count} - 1))").alias("piece"), F.expr(count).alias("count"))
    ends = cut.select("*", F.expr("cast(piece * size div count as int)").alias("a"), F.expr("cast((piece + 1) * size div count as int)").alias("b"))
    return ends.select("word", "n", "role", "size", "piece", F.expr(
        "xxhash64(size, piece, substring(word, 1, a), substring(word, b + 1 + role))").alias("block"))


def ends_alike(words: list[str], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and suffix of the pairs (left, right) of distinct words."""
    width = max(map(len, words)) + 1  # a column of padding ends every comparison
    out = []
    for pad in (lambda w: w.ljust(width, "\0"), lambda w: w[::-1].ljust(width, "\0")):
        matrix = np.frombuffer("".join(map(pad, words)).encode("utf-32-le"), "<u4").reshape(len(words), width)
        found, step = np.empty(len(left), np.int64), max(1, CELLS // width)
        for at in range(0, len(left), step):
            found[at : at + step] = (matrix[left[at : at + step]] != matrix[right[at : at + step]]).argmax(axis=1)
        out.append(found)
    return out[0], out[1]


def pairs_of_blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of rows inside the same block, the rows of blocks of these sizes lying side by side."""
    starts, left, right = np.cumsum(sizes) - sizes, [], []
    for size in np.unique(sizes[sizes > 1]):
        one, two = np.triu_indices(size, 1)
        begin = starts[sizes == size][:, None]
        left.append((begin + one).ravel())
        right.append((begin + two).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def near_in(rows: pa.Table) -> pa.RecordBatch | None:
    """Near pairs of whole blocks, both ways round, each by the first piece that its words agree around."""
    column = {name: rows.column(name).to_numpy() for name in ("size", "piece", "block", "one", "two", "lot", "role", "n")}
    fresh = np.any([np.diff(column[k], prepend=column[k][:1] - 1) != 0 for k in ("size", "piece", "block", "one", "two")], axis=0)
    first = np.flatnonzero(fresh)
    left, right = pairs_of_blocks(np.diff(np.append(first, rows.num_rows)))
    role, lot = column["role"], column["lot"]
    meet = (role[left] + role[right] < 2) & ((lot[left] != lot[right]) | (column["one"] == column["two"])[left])
    left, right = left[meet], right[meet]
    if not len(left):
        return None
    words = rows.column("word").to_pylist()
    ahead, behind = ends_alike(words, left, right)
    size = column["size"][left]
    longer = size + role[left] + role[right]
    near = ahead + behind >= longer - 1
    left, right, ahead, behind, size = (x[near] for x in (left, right, ahead, behind, size))
    own = np.zeros(len(left), bool)
    for length in np.unique(size):
        bounds, at = pieces(int(length)), np.flatnonzero(size == length)
        agree = (ahead[at, None] >= bounds[:-1]) & (behind[at, None] >= length - bounds[1:])
        own[at] = agree.argmax(axis=1) == column["piece"][left[at]]
    left, right = np.concatenate([left[own], right[own]]), np.concatenate([right[own], left[own]])
    if not len(left):
        return None
    word = rows.column("word").combine_chunks()
    return pa.RecordBatch.from_arrays([word.take(pa.array(left)), word.take(pa.array(right)), pa.array(column["n"][right])], ["word", "near", "near_n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all pairs of the distinct words that differ by one code point, both ways round."""
    rows = dealt(words)
    full = rows.groupBy("block").agg(F.count("*").alias("held")).where(F.col("held") > LOT)
    tiled = rows.join(small_side(full), "block", "left").select(
        "*", F.expr(f"cast(ceil(coalesce(held, 1) / {LOT}) as int)").alias("lots")).select(
        "*", F.expr("cast(pmod(xxhash64(word), lots) as int)").alias("lot")).select(
        "word", "n", "role", "size", "piece", "block", "lot", F.explode(F.expr("sequence(0, lots - 1)")).alias("other")).select(
        "*", F.least("lot", "other").alias("one"), F.greatest("lot", "other").alias("two")).drop("other")
    order = ["size", "piece", "block", "one", "two"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, max(1, CELLS // (64 + batch.column("size")[0].as_py())))
                waiting.append(batch.slice(0, take))
                batch, held = batch.slice(take), held + take
                table = pa.Table.from_batches(waiting)
                keys = [table.column(k).to_numpy() for k in order]
                last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if held >= 8 * LOT and len(last):  # all blocks but the last are whole
                    whole = table.slice(0, int(last[-1]) + 1)
                    waiting = table.slice(int(last[-1]) + 1).to_batches()
                    held = table.num_rows - whole.num_rows
                    if (found := near_in(whole)) is not None:
                        yield found
        if waiting and (found := near_in(pa.Table.from_batches(waiting))) is not None:
            yield found

    return tiled.repartition("block", "one", "two").sortWithinPartitions(*order).mapInArrow(compare, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Per word of ``word, n``: its form (the most frequent near word, if ``times`` as frequent) and the root that forms lead to."""
    words = stage(words, "words")
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    known = stage(known.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.less")).alias("form_n")), "forms")
    steps = known.where("form is not null").select("word", F.col("form").alias("root"))
    # each step multiplies the count, so a chain is as long as the counts' logarithm at most; each round doubles what is followed
    most = known.agg(F.max("n")).first()[0] or 1
    longest = sum(1 for k in range(1, 64) if times**k <= most) if times > 1 else 0
    for _ in range(max(0, longest - 1).bit_length()):
        on = small_side(steps.select(F.col("word").alias("root"), F.col("root").alias("further")))
        steps = stage(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
