"""Exact Jaccard join on word shingles by groups and their token unions.

1. Documents of one shingle set are one class; the class stands for all its copies.
2. Shingles get one global order, rare first: by the load of their hash bucket,
   counted over all documents, then by hash. It steers the work only.
3. A class whose first tokens (see 4) are nearly all its own can link with no
   other and is settled. Similar classes are put in groups: those that share one of
   ``KEYS`` min-hashes are compared with the one that has the fewest tokens of its
   own. What comes near it joins its group; what links with it, its part of the group.
4. The token-group matrix holds, per group, the union of its members' prefix
   tokens and the range of their sizes. A set of n shingles needs a common part
   of ``percent * n / 100`` with any partner, so of its n - common + HITS first
   tokens at least HITS are among those of its partner's group: a group whose
   union has fewer of them, or no member of a fitting size, cannot qualify and
   is never opened. Tokens that lie in one group only say nothing and go first.
5. Qualifying groups, and groups of several parts, are opened in chunks of members;
   a query meets a chunk through an index of the chunk's shingles, with exact
   counts. One link to a part is enough, since its members are linked already.

No pairs within a group are formed as rows; a group of copies costs as much as its
members, one of texts that are near but not linked is compared chunk by chunk. Hot
tokens, keys and groups are split or summed before they move.

Rules: null and empty texts have no shingles and are linked with nothing; texts
of fewer words are one shingle; rows repeat as they come, rows of one id and text
are copies; null ids come after all others, a component without another id has a
null id; an empty table gives an empty result; other columns are ignored or, in
``first_of_each``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import discard, order_key, slices, stage, texts
from corridor_spark.llm.components import components
from corridor_spark.llm.shingles import scramble, shingle_sets
from corridor_spark.session import small_side

#: Five words and a similarity of 0.8 unless a caller says otherwise.
WORDS, PERCENT = 5, 80
BUCKETS, KEYS, HITS, CHUNK = 1 << 18, 6, 2, 256


def loads(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles per hash bucket over all documents; one megabyte a task, summed in eight tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in slices(batches, 1_000_000):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            total += np.bincount((np.concatenate(sets) >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["loads"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.float64)
        for batch in batches:
            for raw in batch.column("loads"):
                total += np.frombuffer(raw.as_buffer(), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["loads"])

    summed = texts(docs).select("text").mapInArrow(count, "loads binary").repartition(8).mapInArrow(add, "loads binary").collect()
    return sum((np.frombuffer(r["loads"], np.float64) for r in summed), np.zeros(BUCKETS))


def least_size(percent: int) -> int:
    """Fewest shingles of a set that can link with another set."""
    return -(-percent // (100 - percent)) if percent < 100 else 2**62


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: its key, n_shingles, class (two hashes), min-hash keys and first tokens in the global order."""
    load = loads(docs, words)
    rank = np.searchsorted(np.unique(load), load).astype(np.uint64) << np.uint64(44)
    seeds = np.random.default_rng(5).integers(1, 2**63, KEYS, dtype=np.uint64)
    least = least_size(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1_000_000):
            sets = shingle_sets(part.column("text").to_pylist(), words)
            size, one, two, keys, tokens = [], [], [], [], []
            for s in sets:
                n = len(s)
                size.append(n)
                one.append(int(s.sum(dtype=np.uint64).view(np.int64)) if n else 0)
                two.append(int(scramble(s ^ seeds[0]).sum(dtype=np.uint64).view(np.int64)) if n else 0)
                if n < least:
                    keys.append([])
                    tokens.append([])
                    continue
                keys.append([int(scramble(s ^ x).min().view(np.int64)) for x in seeds])
                take = min(n, n - -(-percent * n // 100) + HITS)
                place = rank[s >> np.uint64(46)] | (scramble(s) >> np.uint64(20))
                tokens.append(s[np.argpartition(place, take - 1)[:take]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64()))], ["key", "n", "one", "two", "keys", "tokens"])

    own = texts(docs).select(order_key().alias("key"), "text")
    return stage(own.mapInArrow(sketch, "key struct<none:boolean,id:bigint,text:bigint>, n long, one long, two long, "
                                        "keys array<long>, tokens array<long>"), "sketches")


def class_texts(classes: DataFrame, wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text`` of the named classes, once each."""
    keys = classes.select("node", "key").join(wanted.distinct(), "node", "leftsemi")
    own = texts(docs).select(order_key().alias("key"), "text")
    return stage(own.join(small_side(stage(keys, "keys")), "key").select("node", "text").dropDuplicates(["node"]), "texts")


def similar_pairs(pairs: DataFrame, have: DataFrame, words: int, percent: int, weak: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are similar to ``weak`` percent, and whether they are to ``percent``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                left, right = (shingle_sets(part.column(c).to_pylist(), words) for c in ("left", "right"))
                common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)])
                union = np.array([len(x) + len(y) for x, y in zip(left, right)]) - common
                rows = part.select(["a", "b"]).append_column("linked", pa.array(100 * common >= percent * union))
                yield rows.filter(pa.array(100 * common >= weak * union))

    both = (pairs.join(have.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
            .join(have.select(F.col("node").alias("b"), F.col("text").alias("right")), "b"))
    return both.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long, linked boolean")


def shared_tokens(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, node) of the first tokens that two classes or more have; and the classes with enough of them to link at all."""
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    shared = stage(tokens.join(often, "token", "leftsemi"), "tokens")
    counts = shared.groupBy("node").agg(F.count("*").alias("shared")).where(F.col("shared") >= HITS)
    alive = classes.select("node", "n", "keys", F.size("tokens").alias("first_tokens")).join(counts, "node")
    return shared, stage(alive.withColumn("alone", F.col("first_tokens") - F.col("shared")), "alive")


def grouped(alive: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Similar pairs of classes that share a min-hash, each with the one of them that has the fewest tokens of its own.

    That is the text the others were made from, if it is there, and they are closer to it than to each other.
    """
    weak = percent // 2  # copies of a text that is not there itself are about this close to each other
    keyed = alive.select("node", "n", "alone", F.posexplode("keys").alias("band", "hash"))
    leaders = (keyed.groupBy("band", "hash").agg(F.min(F.struct("alone", "node", "n")).alias("first"), F.count("*").alias("m")).where("m > 1"))
    fits = F.least("n", F.col("first.n")) * 100 >= F.greatest("n", F.col("first.n")) * weak
    pairs = stage(keyed.join(leaders, ["band", "hash"]).where(fits & (F.col("node") != F.col("first.node")))
                  .select(F.col("node").alias("a"), F.col("first.node").alias("b")).distinct(), "pairs")
    have = class_texts(classes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs)
    found = stage(similar_pairs(pairs, have, words, percent, weak), "similar")
    discard(pairs, have)
    return found


def opened(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, part, group) to compare: a group whose union holds enough of the node's first tokens and has a member that fits.

    Of two groups the later asks the earlier. Inside a group, all parts but the largest ask.
    """
    parts = nodes.groupBy("group", "part").agg(F.count("*").alias("m"))
    main = parts.groupBy("group").agg(F.max(F.struct("m", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    inside = nodes.join(main, "group").where(F.col("part") != F.col("main.part")).select("node", "part", "group")
    tokens = shared.join(nodes, "node")
    across = (tokens.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high"))
              .where("low <> high").select("token"))
    tokens = stage(tokens.join(across, "token", "leftsemi"), "across")
    union = tokens.groupBy("token", "group").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = tokens.join(union.withColumnRenamed("group", "other"), "token")
    fits = (F.col("low") * percent <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * percent)
    outside = (meet.where((F.col("group") > F.col("other")) & fits).groupBy("node", "part", F.col("other").alias("group"))
               .agg(F.count("*").alias("hits")).where(F.col("hits") >= HITS).select("node", "part", "group"))
    asks = stage(inside.unionByName(outside), "opened")
    discard(tokens)
    return asks


def links_across(shared: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links from each class to the parts of its own and other groups in which it has a partner; ``nodes``: node, n, group, part."""
    asks = opened(shared, nodes, percent)
    sizes = asks.groupBy("group").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("asking"))
    members = nodes.select("node", "part", "group").join(sizes, "group", "leftsemi")
    sizes = stage(sizes.join(members.groupBy("group").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks")), "group"), "sizes")
    have = class_texts(classes, asks.select("node").union(members.select("node")), docs)
    spread = lambda column: F.pmod(F.xxhash64("node"), F.col(column)).cast("int")
    each = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    query = (asks.join(sizes, "group").select("node", "part", "group", spread("asking").alias("lot"), each("chunks").alias("chunk"))
             .join(have.select("node", F.col("text").alias("asking_text")), "node"))
    member = (members.join(sizes, "group").select("node", "part", "group", each("asking").alias("lot"), spread("chunks").alias("chunk"))
              .join(have.select("node", F.col("text").alias("member_text")), "node"))

    def meet(asked: pa.Table, there: pa.Table) -> pa.Table:
        left, right = [], []
        sets = shingle_sets(there.column("member_text").to_pylist(), words)
        size, part = np.array([len(s) for s in sets], np.int64), there.column("part").to_numpy()
        tokens, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        queries = shingle_sets(asked.column("asking_text").to_pylist(), words) if len(sets) else []
        for i, (s, own) in enumerate(zip(queries, asked.column("part").to_pylist())):
            low, high = np.searchsorted(tokens, s, "left"), np.searchsorted(tokens, s, "right")
            count = high - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero((100 * common >= percent * (len(s) + size - common)) & (part != own))
            if len(good):  # one link to each part is enough
                first = good[np.unique(part[good], return_index=True)[1]].tolist()
                left += [i] * len(first)
                right += first
        return pa.table({"a": asked.column("node").take(pa.array(left, pa.int64())),
                         "b": there.column("node").take(pa.array(right, pa.int64()))})

    found = stage(query.groupBy("group", "lot", "chunk").cogroup(member.groupBy("group", "lot", "chunk"))
                  .applyInArrow(meet, "a long, b long"), "found")
    discard(asks, sizes, have)
    return found


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: key (its order), n_shingles, first (the order of its component's first document)."""
    drawn = sketches(docs, words, percent)
    classes = stage(drawn.where("n > 0").groupBy("one", "two", "n").agg(
        F.min("key").alias("key"), F.first("keys").alias("keys"), F.first("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    rows = stage(drawn.select("key", "n", "one", "two"), "rows")
    discard(drawn)
    shared, alive = shared_tokens(classes)
    similar = grouped(alive, classes, docs, words, percent)
    near = components(similar.where("linked"))
    groups = components(similar)
    named = lambda links, name: links.select(F.col("a").alias("node"), F.col("b").alias(name))
    nodes = stage(alive.select("node", "n").join(named(near, "part"), "node", "left").join(named(groups, "group"), "node", "left")
                  .select("node", "n", F.coalesce("group", "node").alias("group"), F.coalesce("part", "node").alias("part")), "groups")
    more = links_across(shared, nodes, classes, docs, words, percent)
    done = components(near.unionByName(more))
    known = stage(classes.select("one", "two", "n", "key", "node").join(named(done, "leader"), "node", "left")
                  .withColumn("leader", F.coalesce("leader", "node")), "known")
    firsts = known.groupBy("leader").agg(F.min("key").alias("first"))
    known = stage(known.join(firsts, "leader").select("one", "two", "n", "first"), "firsts")
    discard(classes, shared, alive, similar, near, groups, nodes, more, done)
    return (rows.join(known, ["one", "two", "n"], "left")
            .select("key", F.col("n").alias("n_shingles"), F.coalesce("first", "key").alias("first")))


def labels(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    name = lambda c: F.when(~F.col(f"{c}.none"), F.col(f"{c}.id"))
    return join(docs, words, percent).select(name("key").alias("doc_id"), "n_shingles", name("first").alias("component_id"))


def first_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that come first in their components (rows without words all stay), with all their columns.

    Of rows equal in id and text one stays.
    """
    found = join(docs, words, percent)
    keyed = docs.select(order_key().alias("key"), F.struct("*").alias("row"))
    drop = small_side(stage(found.where("first <> key").select("key").distinct(), "drop"))
    again = small_side(stage(found.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "again"))
    kept = keyed.join(drop, "key", "leftanti")
    return (kept.join(again, "key", "leftanti")
            .unionByName(kept.join(again, "key", "leftsemi").dropDuplicates(["key"])).select("row.*"))
