"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its words: runs of letters in lower case, each between a begin and an
end mark, so that a word costs the same wherever it stands. Training counts the
distinct words of each language over all labelled texts, and from them, as
DataFrame jobs, the grams of ``ORDER`` symbols; lower orders count the distinct
symbols that a gram follows, those at a word's beginning their occurrences.
Each order takes one discount from its counts and gives it to the order below,
down to an even share over the symbols. What is stored is the cost (-log2) of
each gram and the cost of leaving each context, in millionths of a bit, so that
sums do not depend on their order.

Scoring takes the language whose model needs the fewest bits for the words,
divided by the number of symbols; ties go to the first name. Up to
``BROADCAST_GRAMS`` grams the model goes to the tasks as sorted arrays of 64-bit
hashes, with costs beside them; what a symbol costs depends on the ``ORDER``
symbols up to it alone, so a task works out each such window of its new words
once, and keeps the costs of words it has met.
Beyond that the grams stay a table: the distinct words are joined with it, the
texts with the words' costs. Both ways give the same figures.

Rejection is calibrated on all the labelled texts that the counts cover. They
give the usual cost a symbol of each language, whose spread shrinks with the
text's length (a text is ``rejected`` if it costs ``DEVIATIONS`` more), and the
temperature of the posterior that is the score. ``label`` learns from some rows
of a table and labels them all, measuring each text once.

Rules: a null text, or one without a letter, is ``und`` with score 0, and so is
every text if nothing was learned; rows repeat as they come, with null or repeated
ids; texts of any length are read whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import discard, slices, stage, texts

#: Symbols of the longest grams; millionths of a bit.
ORDER, MICRO = 4, 1_000_000
#: Most grams, of all languages together, that go to every task; words whose costs a task keeps.
BROADCAST_GRAMS, KEPT_WORDS = 1_500_000, 200_000
#: How many deviations above the usual cost a text is rejected.
DEVIATIONS = 6
BEGIN, END = "\x02", "\x03"
UNKNOWN = "und"
_LETTERS, _EXACT = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def in_fold(doc_id: str, folds: int = 5) -> Column:
    """Whether a row is held out: the crc32 of its id as text is a multiple of ``folds`` (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for word in words for w in _EXACT.findall(word)]  # numerals that are no letters


# ---- training ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Languages in order, each one's cost of an unknown symbol, the table of grams, and the calibration."""

    languages: list[str]
    unknown: list[int]
    grams: DataFrame | None  # gram, costs and leave: an entry for each language, -1 and 0 where it has none
    usual: dict[str, tuple[float, float]] = field(default_factory=dict)  # mean cost a symbol, and its deviation for one symbol
    sharpness: float = 1.0
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def word_table(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` of the labelled texts, counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, Counter[str]] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words.keys(), pa.string()),
                                                  pa.array(words.values(), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for part in slices(batches):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > KEPT_WORDS:
                yield from flush()
        yield from flush()

    some = texts(docs, "lang").where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    return some.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame) -> list[DataFrame]:
    """For each order from 1 on ``lang, gram, n``: occurrences of the longest grams and of those at a word's beginning, else left neighbours."""
    padded = words.select("lang", "n", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("word"))
    whole = padded.select("lang", "n", F.expr(
        f"explode(transform(sequence(2, length(word)), t -> substring(word, greatest(1, t - {ORDER - 1}), least(t, {ORDER}))))").alias("gram"))
    whole = stage(whole.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    levels = [whole.where(F.length("gram") == ORDER)]
    for k in range(ORDER - 1, 0, -1):
        inner = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
        levels.insert(0, stage(inner.unionByName(whole.where(F.length("gram") == k)), "grams"))
    return levels


def estimate(words: DataFrame) -> Model:
    """Interpolated Kneser-Ney models from ``lang, word, n``."""
    levels = gram_counts(words)
    sizes = {r["lang"]: r["n"] for r in levels[0].groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return Model([], [], None)
    shared = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, 1.0 / (n + 1))))
    below = None
    contexts, found = [], []
    for k, level in enumerate(levels, 1):
        few = {r["lang"]: (r["one"], r["two"]) for r in level.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")).collect()}
        cut = F.create_map(*(F.lit(x) for lang, (one, two) in few.items() for x in (lang, one / (one + 2.0 * two) if one and two else 0.5)))
        rows = level.select("lang", "gram", "n", F.expr(f"substring(gram, 1, {k - 1})").alias("context"), F.expr("substring(gram, 2)").alias("shorter"),
                            cut[F.col("lang")].alias("cut"))
        context = stage(rows.groupBy("lang", "context", "cut").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).select(
            "lang", "context", "total", (F.col("cut") * F.col("kinds") / F.col("total")).alias("left")), "contexts")
        rows = rows.join(context, ["lang", "context"])
        if below is None:
            rows = rows.withColumn("lower", shared[F.col("lang")])
            first = {r["lang"]: r["left"] for r in context.collect()}  # the empty context: one row a language
        else:
            rows = rows.join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"])
            contexts.append(context.select("lang", F.col("context").alias("gram"), "left"))
        below = stage(rows.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("left") * F.col("lower")).alias("p")), "levels")
        found.append(below)
    grams, leave = found[0], contexts[0] if contexts else None
    for more in found[1:]:
        grams = grams.unionByName(more)
    for more in contexts[1:]:
        leave = leave.unionByName(more)
    bits = lambda x: F.round(-F.log2(x) * MICRO).cast("long")
    both = grams.join(leave, ["lang", "gram"], "full").select(
        "lang", "gram", F.coalesce(bits("p"), F.lit(-1).cast("long")).alias("cost"), F.coalesce(bits("left"), F.lit(0).cast("long")).alias("leave"))
    languages = sorted(sizes)
    of = lambda name, none: F.array(*(F.coalesce(F.max(F.when(F.col("lang") == lang, F.col(name))), F.lit(none).cast("long")) for lang in languages))
    table = stage(both.groupBy("gram").agg(of("cost", -1).alias("costs"), of("leave", 0).alias("leave")), "model")
    discard(*levels)
    unknown = [int(round(-np.log2(first[lang] / (sizes[lang] + 1)) * MICRO)) for lang in languages]
    return Model(languages, unknown, table)


def fit(docs: DataFrame) -> Model:
    """Models of all languages in ``lang``, from all texts that have one; not calibrated."""
    words = stage(word_table(docs), "words")
    model = estimate(words)
    discard(words)
    return model


def learn(docs: DataFrame) -> Model:
    """Models of all languages in ``lang``, from all texts that have one, calibrated on the same texts."""
    model = fit(docs)
    if model.grams is not None:
        measured = stage(measure(docs.where("lang is not null"), model, "lang"), "measured")
        calibrate(model, measured)
        discard(measured)
    return model


def calibrate(model: Model, measured: DataFrame) -> None:
    """Usual cost of each language and the posterior's temperature, from all measured texts (``lang, bits, symbols``)."""
    at = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int")
    own = F.get("bits", at - 1) / MICRO
    rows = measured.where((F.col("symbols") > 0) & (at > 0)).select("lang", "bits", "symbols", own.alias("own"))
    mean = {r["lang"]: r["mean"] for r in rows.groupBy("lang").agg((F.sum("own") / F.sum("symbols")).alias("mean")).collect()}  # one row a language
    if not mean:
        return
    usual = F.create_map(*(F.lit(x) for pair in mean.items() for x in pair))[F.col("lang")]
    spread = F.sqrt(F.avg(F.pow(F.col("own") / F.col("symbols") - usual, F.lit(2)) * F.col("symbols")))
    model.usual = {r["lang"]: (round(mean[r["lang"]], 9), round(r["spread"], 9)) for r in rows.groupBy("lang").agg(spread.alias("spread")).collect()}
    gains = rows.select(*(F.log((1.0 / posterior_sum("bits", F.col("own") * MICRO, 2.0**-k)) + 1e-300).alias(f"g{k}") for k in range(13)))
    gain = gains.agg(*(F.round(F.sum(c), 6).alias(c) for c in gains.columns)).first()
    model.sharpness = 2.0 ** -max(range(13), key=lambda k: gain[f"g{k}"])


def posterior_sum(bits: str, of: Column, sharpness: float) -> Column:
    """One divided by the posterior of the language that costs ``of``."""
    return F.aggregate(bits, F.lit(0.0), lambda sum_, b: sum_ + F.pow(F.lit(2.0), -(b - of) / MICRO * sharpness))


# ---- scoring -------------------------------------------------------------------------------------------------------


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (symbol, order) of the grams that end at each symbol of the padded words, 0 where the word is too short; each word's end."""
    joined = np.frombuffer("".join(f"{BEGIN}{w}{END}" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(joined)) - np.repeat(starts, ends - starts)
    out, rolled = np.zeros((len(joined), ORDER), np.uint64), np.zeros(len(joined), np.uint64)
    for k in range(ORDER):  # the symbol k places back comes in with a weight of its own
        back = np.zeros(len(joined), np.uint64)
        back[k:] = joined[: len(joined) - k]
        weight = pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64)
        mixed = (back + np.uint64(1)) * np.uint64(weight)
        rolled = rolled + (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        whole = place >= k
        out[whole, k] = (rolled ^ (rolled >> np.uint64(31)))[whole] * np.uint64(2) + np.uint64(1)
    return out, ends


def one_hash(gram: str) -> int:
    """The hash of one gram, as ``gram_hashes`` has it at its last symbol."""
    return int(gram_hashes([gram])[0][len(gram), len(gram) - 1])


def symbol_costs(index: np.ndarray, earlier: np.ndarray, costs: np.ndarray, leave: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Cost of each symbol in each language; ``index`` (symbol, order) has the row of each gram in ``costs`` and ``leave``, -1 without
    one, and ``earlier`` the same for the symbol before."""
    total = np.zeros((len(index), costs.shape[1]), np.int64)
    opened = np.ones(total.shape, bool)
    for k in range(ORDER - 1, -1, -1):
        row = index[:, k]
        here = np.where((row >= 0)[:, None], costs[row], -1)
        seen = opened & (here >= 0)
        total += np.where(seen, here, 0)
        opened &= ~seen
        if k:  # leave the context, the gram one shorter that ends a symbol earlier
            before = earlier[:, k - 1]
            total += np.where(opened & (before >= 0)[:, None], leave[before], 0)
    return total + np.where(opened, unknown, 0)


def word_costs(index: np.ndarray, ends: np.ndarray, costs: np.ndarray, leave: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Cost of each word in each language from all its symbols."""
    total = symbol_costs(index, np.concatenate([np.full((1, ORDER), -1), index[:-1]]), costs, leave, unknown)
    starts = np.concatenate([[0], ends[:-1]])
    total[starts] = 0  # the begin mark is given
    return np.add.reduceat(total, starts, axis=0) if len(starts) else total[:0]


_KEPT: dict[str, object] = {}


class Scorer:
    """Costs of words from sorted hash arrays; keeps what it has computed for as long as the worker lives."""

    def __init__(self, token: str, keys: np.ndarray, costs: np.ndarray, leave: np.ndarray, unknown: np.ndarray):
        if _KEPT.get("token") != token:
            _KEPT.clear()
            _KEPT.update(token=token, words={}, costs=np.zeros((0, len(unknown)), np.int64))
        self.keys, self.costs, self.leave, self.unknown = keys, costs, leave, unknown

    def of(self, words: list[str]) -> tuple[dict[str, int], np.ndarray]:
        """Numbers of the words (and others), and the costs by number."""
        known: dict[str, int] = _KEPT["words"]
        fresh = [w for w in words if w not in known]
        if fresh:
            if len(known) + len(fresh) > KEPT_WORDS:
                known.clear()
                _KEPT["costs"] = _KEPT["costs"][:0]
                fresh = words
            found = self.price(*gram_hashes(fresh))
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            _KEPT["costs"] = np.concatenate([_KEPT["costs"], found])
        return known, _KEPT["costs"]

    def price(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Costs of the words, each distinct window of ``ORDER`` symbols (fewer where a word begins) worked out once."""
        longest = hashes[:, 0].copy()
        for k in range(1, ORDER):
            np.copyto(longest, hashes[:, k], where=hashes[:, k] != 0)
        _, first, which = np.unique(longest, return_index=True, return_inverse=True)
        cost = symbol_costs(self.rows(hashes[first]), self.rows(hashes[first - 1]), self.costs, self.leave, self.unknown)
        cost[which[0]] = 0  # the begin mark is given
        return np.add.reduceat(cost[which], np.concatenate([[0], ends[:-1]]), axis=0)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes.ravel()).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == hashes.ravel(), at, -1).reshape(hashes.shape)

    def bits(self, split: list[list[str]]) -> np.ndarray:
        """Costs of texts, given as their words."""
        flat = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        words = flat.dictionary.to_pylist()
        total = np.zeros((len(split), len(self.unknown)), np.int64)
        if words:
            known, costs = self.of(words)
            each = costs[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            some = np.flatnonzero(sizes)
            total[some] = np.add.reduceat(each[flat.indices.to_numpy()], (np.cumsum(sizes) - sizes)[some], axis=0)
        return total


def measure(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """``doc_id``, the named columns, ``bits`` (cost of the text in each language, millionths) and ``symbols`` (0 without letters)."""
    small = model.grams.limit(BROADCAST_GRAMS + 1).count() <= BROADCAST_GRAMS
    return _by_arrays(docs, model, more) if small else _by_join(docs, model, more)


def _by_arrays(docs: DataFrame, model: Model, more: tuple[str, ...]) -> DataFrame:
    table = model.grams.toArrow()  # at most BROADCAST_GRAMS rows
    width = len(model.languages)
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy().reshape(-1, width)
    keys = hashes_of(table.column("gram").to_pylist())
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast(
        (model.token, keys[order], flat("costs")[order].astype(np.int32), flat("leave")[order].astype(np.int32), np.array(model.unknown)))
    some = texts(docs, *more)
    arrow = pa.schema([("bits", pa.list_(pa.int64())), ("symbols", pa.int64())])
    names = [c for c in some.columns if c != "text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for part in slices(batches):
            split = [words_of(t) for t in part.column("text").to_pylist()]
            bits = pa.FixedSizeListArray.from_arrays(scorer.bits(split).ravel(), width).cast(arrow.field("bits").type)
            symbols = [sum(map(len, words)) + len(words) for words in split]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), bits, pa.array(symbols, pa.int64())],
                                             [*names, *arrow.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema if f.name != "text")
    return some.mapInArrow(judge, f"{kept}, bits array<long>, symbols long")


def hashes_of(grams: list[str]) -> np.ndarray:
    """Hashes of grams of any order, each at its last symbol."""
    hashes, ends = gram_hashes(grams)
    lengths = np.fromiter(map(len, grams), np.int64, len(grams))
    return hashes[ends - 2, lengths - 1]


def _by_join(docs: DataFrame, model: Model, more: tuple[str, ...]) -> DataFrame:
    """The same from the table of grams, for models too large for the tasks: joined with distinct words, these with distinct texts."""
    some = texts(docs, *more).select("*", F.xxhash64("text").alias("one"), F.xxhash64("text", F.lit(1)).alias("two"))
    width, unknown = len(model.languages), np.array(model.unknown)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for i, text in enumerate(part.column("text").to_pylist()):
                if words := Counter(words_of(text)):
                    one, two = (pa.array([part.column(c)[i].as_py()] * len(words), pa.int64()) for c in ("one", "two"))
                    yield pa.RecordBatch.from_arrays([one, two, pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())],
                                                     ["one", "two", "word", "n"])

    held = stage(some.select("one", "two", "text").dropDuplicates(["one", "two"]).mapInArrow(split, "one long, two long, word string, n long"), "held")
    symbol = held.select("word").distinct().select("word", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("padded")).select(
        "word", "padded", F.expr("explode(sequence(1, length(padded)))").alias("t"))
    grams = symbol.select("word", "t", F.expr(f"explode(sequence(1, least(t, {ORDER})))").alias("k"), "padded").select(
        "word", "t", "k", F.expr("substring(padded, t - k + 1, k)").alias("gram"))
    looked = grams.join(model.grams, "gram", "left").groupBy("word").agg(F.collect_list(F.struct("t", "k", "costs", "leave")).alias("grams"))

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs, leave, bits = [[-1] * width], [[0] * width], []
            for word, found in zip(batch.column("word").to_pylist(), batch.column("grams").to_pylist()):
                index = np.full((len(word) + 2, ORDER), -1)
                for g in found:
                    if g["costs"] is not None:
                        index[g["t"] - 1, g["k"] - 1] = len(costs)
                        costs.append(g["costs"])
                        leave.append(g["leave"])
                bits.append(word_costs(index, np.array([len(index)]), np.array(costs), np.array(leave), unknown)[0].tolist())
                costs, leave = costs[:1], leave[:1]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(bits, pa.list_(pa.int64()))], ["word", "bits"])

    priced = looked.mapInArrow(price, "word string, bits array<long>")
    sums = held.join(priced, "word").groupBy("one", "two").agg(
        F.array(*(F.sum(F.col("bits")[i] * F.col("n")) for i in range(width))).alias("bits"),
        F.sum((F.length("word") + 1) * F.col("n")).alias("symbols"))
    joined = some.join(stage(sums, "bits"), ["one", "two"], "left")
    nothing = F.array(*(F.lit(0).cast("long") for _ in range(width)))
    return joined.select("doc_id", *more, F.coalesce("bits", nothing).alias("bits"), F.coalesce("symbols", F.lit(0)).alias("symbols"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, ``lang_pred``, ``score`` (the calibrated posterior), ``bits_per_symbol`` and ``rejected`` (unlike every language)."""
    if model.grams is None:
        return predict(docs, model)
    return predict(measure(docs, model), model)


def label(docs: DataFrame, learned: Column) -> DataFrame:
    """``identify`` for all rows, with what the ``learned`` rows with a ``lang`` teach."""
    model = fit(docs.where(learned))
    if model.grams is None:
        return predict(docs, model)
    rows = docs.select("doc_id", "text", "lang", F.coalesce(learned & F.col("lang").isNotNull(), F.lit(False)).alias("learned"))
    measured = stage(measure(rows, model, "lang", "learned"), "measured")
    calibrate(model, measured.where("learned"))
    return predict(measured, model)


def predict(measured: DataFrame, model: Model) -> DataFrame:
    """The columns of ``identify`` from measured texts."""
    if model.grams is None:
        return measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("bits_per_symbol"), F.lit(True).alias("rejected"))
    best = F.array_min("bits")
    shares = posterior_sum("bits", F.col("best"), model.sharpness)
    names, usual = F.array(*map(F.lit, model.languages)), model.usual
    mean, spread = (F.array(*(F.lit(usual[x][i] if x in usual else None).cast("double") for x in model.languages)) for i in (0, 1))
    rows = measured.select(F.col("doc_id").cast("long").alias("doc_id"), "bits", "symbols", best.alias("best"), F.array_position("bits", best).alias("at"))
    said = F.col("symbols") > 0
    per = F.col("best") / MICRO / F.col("symbols")
    at = F.col("at").cast("int")
    beyond = per > F.element_at(mean, at) + DEVIATIONS * F.element_at(spread, at) / F.sqrt("symbols")
    return rows.select("doc_id", F.when(said, F.element_at(names, at)).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(said, 1.0 / shares).otherwise(0.0).alias("score"), F.when(said, per).alias("bits_per_symbol"),
                       F.when(said, F.coalesce(beyond, F.lit(False))).otherwise(True).alias("rejected"))
