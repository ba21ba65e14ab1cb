"""Quality rules as a short-circuit cascade, ordered by what a sample says of each rule's cost and selectivity.

A document that fails a rule is rejected and no later rule looks at it, so a
cheap rule that rejects much belongs first. On a bounded sample every rule is
timed and its rejections counted; the order that minimises the expected cost of
a cascade of independent rules is rejections per unit of cost, falling. The
order changes only the work: a document is kept if no rule rejects it.

Rules: null text is empty (no words, rejected as too short); rows repeat as they
come, with null or repeated ids; a text of any length is one row; an empty table
gives an empty result; ties in the order go to the rule listed first.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import sample, slices, texts

SYMBOLS = "#*$%&|<>"
#: Texts of the sample on which the cascade is ordered; longer texts than 100,000 characters are not timed.
SAMPLE_ROWS = 200


class Text:
    """Measures of one text; each is computed when a rule first asks for it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes are split at ASCII white space

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\r\x0b\x0c"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that come twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        often = {k for k, n in Counter(windows).items() if n > 1}
        total, free = 0, 0  # free: the first word not yet counted
        for i, window in enumerate(windows):
            if window in often:
                total += i + 3 - max(i, free)
                free = i + 3
        return total


#: Rules of the cascade: name and what rejects. The first two are the contract's base rules.
RULES: dict[str, Callable[[Text], bool]] = {
    "too_short": lambda t: t.n_words < 50,
    "repeats": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
    "dup_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
}


def cascade(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, ordered by rejections per second on ``rows`` sampled documents (bounded, by a hash of the text)."""
    some = [r["text"] for r in sample(texts(docs).where(F.length("text") < 100_000), rows, "text", salt=17).collect()]
    gain = {}
    for name, rejects in rules.items():
        began = time.perf_counter()
        rejected = sum(rejects(Text(t)) for t in some)
        gain[name] = rejected / max(time.perf_counter() - began, 1e-9)
    return sorted(rules, key=lambda name: -gain[name])


def measure(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, order: list[str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, ``base_failed`` and ``kept``."""
    order = order or cascade(docs, rules)
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean")
    names = [c.split()[0] for c in schema.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for text in part.column("text").to_pylist():
                t = Text(text)
                failed = RULES["too_short"](t) or RULES["repeats"](t)
                out.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed,
                            not failed and not any(rules[name](t) for name in order)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in list(zip(*out))[:5]),
                                              *(pa.array(c, pa.bool_()) for c in list(zip(*out))[5:])], names)

    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; a rule runs only on what those before it let through."""
    order = cascade(docs, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            good = [not any(rules[name](t) for name in order) for t in map(Text, (x or "" for x in part.column("text").to_pylist()))]
            if any(good):
                yield part.filter(pa.array(good))

    return docs.mapInArrow(judge, docs.schema)
