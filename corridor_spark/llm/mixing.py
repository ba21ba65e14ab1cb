"""Mixing sources to target weights by a low-discrepancy schedule over equal-token blocks.

Sources get targets in words: shares by weight, none above ``most`` times its
size, the excess shared again among the rest. Every source's documents are
shuffled (by a hash) into one stream, cut into blocks of ``block_words`` words.
Slot j of the schedule is the point j·g mod 1 of the golden-ratio sequence
(exact integers modulo 2^31); it belongs to the source whose stretch of the
cumulative weights holds it. Slots are ranked per source, and rank r opens block
r of the stream, round after round. Neighbouring slots thus mix in proportion at
every length. A source's last slot is cut at its target; the few slots by which
the sequence is off are dropped or added at the end, so each source gives its
target rounded to a word.

Ranks and positions are sums per bucket, then per row inside a bucket, so no
source is ever gathered in one task. Only the table of sources, one row each, is
ordered as a whole.

Rules: null text is empty (size 0, nothing taken); null source is a source of
its own, the last; null and repeated ids are rows like others; a text of any
length spans as many blocks as it needs; ties in the shuffle are equal rows; an
empty table gives an empty result; other columns are ignored or, in
``mix_documents``, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.llm.common import WORD, discard, stage, texts

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 512
SEED = "mix"
#: Points of the schedule lie on 0 … RING - 1; STEP is RING over the golden ratio, made odd.
RING, STEP = 2**31, 1327217885


def shuffle_key(seed: str = SEED) -> Column:
    """Place of a row in its source's shuffled stream."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), "text"))


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return (texts(docs, "source")
            .select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), shuffle_key(seed).alias("key"))
            .withColumn("bucket", F.substring("key", 1, 3)))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source: sid, words, target; sources by code point, null last, weights repeating."""
    everything = Window.partitionBy()  # one row per source
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = sources.withColumn("sid", place).withColumn("weight", weight).withColumn("cap", (F.col("words") * most).cast("double"))
    poorest = Window.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    # what is left for a source and those above it once all below it have their cap, per unit of weight
    left = F.sum("words").over(everything).cast("double") - F.coalesce(F.sum("cap").over(poorest), F.lit(0.0))
    load = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(poorest), F.lit(0.0))
    level = ranked.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("level", left / load)
    fair = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(everything)["level"]
    return (level.withColumn("fair", fair)
            .select("source", "sid", "words", F.least("cap", F.coalesce("fair", F.lit(0.0)) * F.col("weight")).alias("target")))


def plan_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS,
                 seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with sid, source_size, target, start; sources with their block counts)."""
    own = stage(sized(docs, seed), "mix-sizes")
    buckets = own.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    taken = F.floor(F.col("target") + 0.5)
    blocks = lambda words: F.ceil(words / F.lit(block_words))
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0)
    sources = (targets(buckets.groupBy("source").agg(F.sum("words").alias("words")), weights, most)
               .withColumn("take", taken).withColumn("rounds", rounds.cast("long"))
               .withColumn("rest", F.col("take") - F.col("rounds") * F.col("words"))
               .withColumn("n_blocks", blocks(F.col("words")))
               .withColumn("n_slots", F.col("rounds") * F.col("n_blocks") + blocks(F.col("rest"))))
    sources = stage(sources, "mix-sources")
    inside = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = own.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, same(placed, offsets) & (placed["bucket"] == offsets["bucket"])).select(
        placed["*"], (F.col("inside") + F.col("before")).alias("start"))
    documents = placed.join(sources, same(placed, sources)).select(
        "doc_id", "key", "sid", "size", F.col("words").alias("source_size"), "target", "start")
    documents = stage(documents, "mix-places")
    discard(own)
    return documents, sources


def schedule(sources: DataFrame) -> DataFrame:
    """``slot, sid, round, block`` in the order of the mix."""
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()
    bits = min(20, (4 * n).bit_length())  # cells of the ring; at least four per source up to a quarter of a million
    wide = RING >> bits
    upto = F.sum("n_slots").over(Window.orderBy("sid"))
    edge = lambda c: F.floor(c.cast("double") * (RING / max(total, 1))).cast("long")
    stretches = (sources.where("n_slots > 0").withColumn("high", edge(upto)).withColumn("low", edge(upto - F.col("n_slots")))
                 .where("high > low")
                 .withColumn("cell", F.explode(F.sequence((F.col("low") / wide).cast("long"), ((F.col("high") - 1) / wide).cast("long"))))
                 .select("sid", "low", "high", "cell"))
    points = (spark.range(total).select(F.col("id").alias("slot"), (F.col("id") % RING * STEP % RING).alias("point"))
              .withColumn("cell", (F.col("point") / wide).cast("long")))
    dealt = (points.join(stretches, "cell").where("point >= low AND point < high")
             .select("slot", "sid", F.shiftright("slot", 14).alias("slice")))
    counts = dealt.groupBy("sid", "slice").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    ranked = (dealt.withColumn("inside", F.row_number().over(Window.partitionBy("sid", "slice").orderBy("slot")) - 1)
              .join(counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))), ["sid", "slice"])
              .select("slot", "sid", (F.col("earlier") + F.col("inside")).alias("turn")))
    have = counts.groupBy("sid").agg(F.sum("n").alias("have"))
    short = (sources.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < n_slots")
             .withColumn("turn", F.explode(F.sequence("have", F.col("n_slots") - 1)))
             .select((F.lit(total) + F.col("turn")).alias("slot"), "sid", "turn"))
    return (ranked.unionByName(short).join(sources.select("sid", "n_blocks", "n_slots"), "sid").where("turn < n_slots")
            .select("slot", "sid", F.floor(F.col("turn") / F.col("n_blocks")).alias("round"),
                    (F.col("turn") % F.col("n_blocks")).alias("block")))


def mix(documents: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of the mix: ``slot, sid, round, key, start`` and the words ``[low, high)`` of the document that the slot takes."""
    slots = (schedule(sources).join(sources.select("sid", "rounds", "rest", "words"), "sid")
             .withColumn("end", F.when(F.col("round") < F.col("rounds"), F.col("words")).otherwise(F.col("rest")))
             .select("slot", "sid", "round", "block", F.least((F.col("block") + 1) * block_words, "end").alias("end")))
    pieces = (documents.where("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words),
                                                        F.floor((F.col("start") + F.col("size") - 1) / block_words))))
              .select("sid", "block", "key", "start", "size"))
    low = F.greatest(F.col("block") * block_words, "start") - F.col("start")
    high = F.least("end", F.col("start") + F.col("size")) - F.col("start")
    return (slots.join(pieces, ["sid", "block"])
            .select("slot", "sid", "round", "key", "start", low.alias("low"), high.alias("high")).where("high > low"))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken."""
    documents, sources = plan_sources(docs, weights, most, block_words)
    # a start is one document's among those with words
    taken = (mix(documents, sources, block_words).groupBy("sid", "start")
             .agg(F.sum(F.col("high") - F.col("low")).alias("words")))
    return (documents.join(taken, ["sid", "start"], "left")
            .select("doc_id", "size", "source_size", "target",
                    F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: a row per round in which a document is taken, cut after the words that the round takes.

    Columns are those of ``docs``; ``n_chars``, where it is one, is counted anew.
    """
    documents, sources = plan_sources(docs, weights, most, block_words)
    takes = (mix(documents, sources, block_words).groupBy("sid", "start", "round", "key").agg(F.max("high").alias("taken_words"))
             .join(documents.where("size > 0").select("sid", "start", "size"), ["sid", "start"])
             .select("key", "size", "taken_words"))
    own = texts(docs.select("doc_id", "text", F.struct("*").alias("row")), "row")
    # rows equal in id and text are one row here: their takes are counted together
    rows = own.select(shuffle_key().alias("key"), "text", "row").dropDuplicates(["key"]).join(takes, "key")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), 0), 1, F.col("taken_words").cast("int")), "")
    rows = rows.withColumn("part", F.when(F.col("taken_words") < F.col("size"), part).otherwise(F.col("text")))
    row = F.col("row").withField("text", F.col("part"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("part").cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")
