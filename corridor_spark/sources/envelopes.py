"""Records of large JSON envelopes ``{..., "records": [{...}, {...}], ...}``, one file read by many tasks.

Spark's text reader cuts a file into pieces at each closing brace, so blocks of one
file go to many tasks. Whether a piece begins inside a string, and how deep it is
nested, depends on all that stands before it: each block is summed up for both
cases (it begins inside a string or not), the few sums of a file are put together,
and every piece then knows its state. A piece that is a whole record is parsed where
it is; the pieces of nested records are brought together by their record.

Rules: the array holds objects, and numbers or nulls, which are left out; only the first array
of that name at the top level counts; a file without it has no records; a file that
breaks off ends with its last whole record; a record that is not valid JSON for the
schema has null fields; files are UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corridor_spark.session import small_side, stage

PIECES = ("file string, block long, n long, value string, odd boolean, outside long, inside long, "
          "odd_after boolean, outside_after long, inside_after long")
_ESCAPED = re.compile(r"\\.", re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]', re.S)


def effect(value: str) -> tuple[int, int, int]:
    """Quotes of a piece, and how much deeper it ends if it begins outside, or inside, a string (its brace included)."""
    parts = (_ESCAPED.sub("", value) if "\\" in value else value).split('"')
    deeper = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[k::2]) for k in (0, 1)]
    quotes = len(parts) - 1
    return quotes, deeper[0] - (quotes % 2 == 0), deeper[1] - (quotes % 2)


def array_start(value: str, depth: int, quoted: bool, key: str) -> int | None:
    """Place behind the bracket of the array ``key`` of the outermost object, in a piece that begins at ``depth``, in a string or not."""
    begin = _STRING_END.match(value) if quoted else None
    if quoted and not begin:
        return None
    for token in _TOKEN.finditer(value, begin.end() if begin else 0):
        if token.group() in "{[":
            depth += 1
        elif token.group() in "]}":
            depth -= 1
        elif depth == 1 and token.group() == f'"{key}"' and (found := re.compile(r"\s*:\s*\[").match(value, token.end())):
            return found.end()
    return None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, state = None, 0, (False, 0, 0)
        for batch in batches:
            out = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    at, n, state = (file, block), 0, (False, 0, 0)
                quotes, outside, inside = effect(value)
                odd = state[0]
                after = (odd ^ bool(quotes % 2), state[1] + (inside if odd else outside), state[2] + (outside if odd else inside))
                out.append((file, block, n, value, *state, *after))
                n, state = n + 1, after
            yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out], schema)

    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PIECES.split(", ")])
    return stage(raw.mapInArrow(number, PIECES), "envelope")


def _states(pieces: DataFrame) -> DataFrame:
    """Pieces with ``at`` (block and number), ``quoted``, ``depth`` before and ``after`` them, and whether they end in a string."""
    last = F.max_by(F.struct("odd_after", "outside_after", "inside_after"), "n").alias("sum")
    blocks = pieces.groupBy("file", "block").agg(last).select("file", "block", "sum.*")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of a file
    blocks = (blocks.withColumn("starts", F.coalesce(F.sum(F.col("odd_after").cast("int")).over(before), F.lit(0)) % 2 == 1)
              .withColumn("deeper", F.when(F.col("starts"), F.col("inside_after")).otherwise(F.col("outside_after")))
              .select("file", "block", "starts", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("base")))
    by = lambda a, b: F.col("base") + F.when(F.col("starts"), F.col(b)).otherwise(F.col(a))
    return pieces.join(small_side(blocks), ["file", "block"]).select(
        "file", F.struct("block", "n").alias("at"), "value", (F.col("starts") != F.col("odd")).alias("quoted"),
        by("outside", "inside").alias("depth"), by("outside_after", "inside_after").alias("after"),
        (F.col("starts") != F.col("odd_after")).alias("quoted_after"))


def _located(pieces: DataFrame, key: str) -> DataFrame:
    """Pieces of files that hold the array, with its ``first`` piece, the ``place`` in it, and the piece in which the array ``ends``."""
    states = _states(pieces)
    asked = states.where(F.col("value").contains(f'"{key}"')).select("file", "at", "value", "depth", "quoted")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [array_start(*piece, key) for piece in zip(*(batch.column(c).to_pylist() for c in ("value", "depth", "quoted")))]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("at"), pa.array(found, pa.int64())], ["file", "at", "place"])

    starts = (asked.mapInArrow(seek, "file string, at struct<block: bigint, n: bigint>, place long").where("place IS NOT NULL")
              .groupBy("file").agg(F.min(F.struct("at", "place")).alias("s")).select("file", F.col("s.at").alias("first"), "s.place"))
    found = states.join(small_side(starts), "file")
    rest = F.when(F.col("at") == F.col("first"), F.expr("substring(value, place + 1)")).otherwise(F.col("value"))
    opens = (F.col("at") == F.col("first")) | ((F.col("at") > F.col("first")) & (F.col("depth") == 2) & ~F.col("quoted"))
    found = found.withColumns({"rest": rest, "opens": opens})
    closed = found.where(F.col("opens") & ~F.regexp_like("rest", F.lit(r"^[^{\]]*\{"))).groupBy("file").agg(F.min("at").alias("ends"))
    return found.join(small_side(closed), "file", "left")


def texts(spark: SparkSession, path: str, key: str = "records") -> DataFrame:
    """``file, text``: the JSON text of every object in the array ``key`` of the envelopes under ``path``."""
    found = _located(_pieces(spark, path), key)
    held = found.where((F.col("at") >= F.col("first")) & (F.col("ends").isNull() | (F.col("at") < F.col("ends"))))
    whole = (F.col("after") == 2) & ~F.col("quoted_after")
    text = F.concat(F.when(F.col("opens"), F.regexp_extract("rest", r"(?s)^[^{]*(.*)$", 1)).otherwise(F.col("value")), F.lit("}"))
    held = held.select("file", "at", "opens", whole.alias("closes"), text.alias("text"))
    alone = held.where("opens AND closes").select("file", "text")
    parts = held.where("NOT (opens AND closes)")
    in_block = Window.partitionBy("file", "at.block").orderBy("at.n").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("opens"), F.col("at"))
    parts = parts.withColumn("record", F.last(opened, ignorenulls=True).over(in_block))
    over = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block of a file
    carried = (held.where("NOT (opens AND closes)").groupBy("file", F.col("at.block").alias("block")).agg(F.max(opened).alias("top"))
               .select("file", "block", F.last("top", ignorenulls=True).over(over).alias("carried")))
    parts = (parts.withColumn("block", F.col("at.block")).join(small_side(carried), ["file", "block"])
             .withColumn("record", F.coalesce("record", "carried")))
    joined = (parts.groupBy("file", "record").agg(  # the pieces of one record
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"), F.max("closes").alias("closes"))
        .where("closes").select("file", F.array_join(F.transform("p", lambda x: x.text), "").alias("text")))
    return alone.unionByName(joined)


def records(spark: SparkSession, path: str, schema: str, key: str = "records") -> DataFrame:
    """The records of the envelopes under ``path`` in columns of ``schema``."""
    return texts(spark, path, key).select(F.from_json("text", schema).alias("r")).select("r.*")


def heads(spark: SparkSession, path: str, schema: str, key: str = "records") -> DataFrame:
    """The envelopes' own fields, in columns of ``schema``: one row per file that holds the array."""
    found = _located(_pieces(spark, path), key)
    first: Column = F.col("at") == F.col("first")
    shown = found.where((F.col("at") <= F.col("first")) | (F.col("at") >= F.col("ends")))
    closing = F.concat("value", F.lit("}"))
    begin = F.expr("substring(value, 1, place)")
    text = (F.when(first & (F.col("ends") == F.col("first")), closing).when(first, begin)
            .when(F.col("at") == F.col("ends"), F.concat(F.lit("]"), F.regexp_replace(closing, r"(?s)^[^\]]*\]", ""))).otherwise(closing))
    whole = shown.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", text.alias("text")))).alias("p"))  # without the records
    return whole.select(F.from_json(F.array_join(F.transform("p", lambda x: x.text), ""), schema).alias("h")).select("h.*")
