"""URL filter: host-and-path rules, and for what no rule fits a logistic regression on hashed character n-grams.

The model learns from a small labelled table (host, path, verdict): rows that a
rule decides, at most ``LABELLED`` of them, chosen by a hash, at most half of
them of one verdict, so a rare verdict is there too. Host and path are
cut into character n-grams apart, each n-gram is hashed to one of 2^16 weights,
and a URL's score is the sum of its weights over the root of their number. The
weights are fitted in numpy on that table and sent to the tasks (half a
megabyte, whatever the input).

Rules: a null URL or one without ``://`` has an empty host and path, fits no rule
and is judged by the model, which lets an empty URL pass; rows repeat as they
come; of rules that fit the longest wins, among equally long ones the first;
without labelled rows of both kinds every other URL is allowed; an empty table
gives an empty result; other columns are ignored; long URLs are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import sample

#: The most labelled rows that the model is fitted on.
LABELLED = 4000
BITS, GRAMS = 16, (3, 4, 5)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(F.col(url), F.lit("://"))
    rest = F.when(at > 0, F.substring(F.col(url), at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, weight's number) of every n-gram; host and path are marked apart and hashed by a rolling polynomial."""
    parts = [x for h, p in zip(hosts, paths) for x in (b"\x01" + h.encode() + b"\x02", b"\x03" + p.encode() + b"\x04")]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    part = np.repeat(np.arange(len(parts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # characters up to the part's end
    rows, numbers = [], []
    for n in GRAMS:
        where = np.flatnonzero(left >= n)
        value = np.full(len(where), n + 1, np.uint64)
        for j in range(n):
            value = value * np.uint64(1_099_511_628_211) + data[where + j]  # overflow wraps
        value ^= value >> np.uint64(29)
        value = value * np.uint64(0x9E3779B97F4A7C15) + part[where].astype(np.uint64) % np.uint64(2)
        rows.append(part[where] // 2)
        numbers.append((value >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(numbers)


def scores(hosts: list[str], paths: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    row, number = features(hosts, paths)
    count = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
    return np.bincount(row, weights[number], minlength=len(hosts)) / np.sqrt(count) + bias


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 150, rate: float = 0.1, shrink: float = 1e-4
        ) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression, both classes of equal weight, by Adam on all rows at a time."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if len(set(blocked.tolist())) < 2:
        return weights, -1.0
    row, number = features(hosts, paths)
    root = np.sqrt(np.bincount(row, minlength=len(hosts)))
    balance = np.where(blocked, 0.5 / blocked.sum(), 0.5 / (~blocked).sum())
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights[number], minlength=len(hosts)) / root + bias
        error = balance * (1 / (1 + np.exp(-z)) - blocked)
        slope = np.append(np.bincount(number, (error / root)[row], minlength=len(weights)) + shrink * weights, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def ruled(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    host, path = host_and_path()
    rule, verdict = fitting_rule(rules)
    return (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("rule", rule).withColumn("decided", verdict))


def labelled(found: DataFrame, rows: int = LABELLED) -> DataFrame:
    """At most ``rows`` rows that a rule decides, chosen by a hash; equal URLs once.

    Each verdict gives half of the rows at most, so both are there whenever the table has both.
    """
    allowed, blocked = (sample(found.where(F.col("decided") == v), rows // 2, "host", "path", "decided", salt=5) for v in ("allow", "block"))
    return allowed.unionByName(blocked)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, table: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict; ``table`` (host, path, decided) replaces the rules' own labels."""
    found = ruled(pages, rules)
    table = labelled(found if table is None else table).collect()  # LABELLED rows at most
    weights, bias = fit([r["host"] for r in table], [r["path"] for r in table], np.array([r["decided"] == "block" for r in table], bool))
    weights = weights.astype(np.float32)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            if not hosts:
                continue
            bad = scores(hosts, paths, weights, bias) > 0
            said = [v or ("block" if x and (h or p) else "allow")
                    for v, x, h, p in zip(batch.column("decided").to_pylist(), bad, hosts, paths)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(said, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return found.mapInArrow(verdicts, f"page_id {kind}, host string, path string, rule string, verdict string")
