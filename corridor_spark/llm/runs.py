"""Runs of repeated words: suffix trees of a text and its reversal, constant-time LCE, Lyndon roots extended both ways.

A run is a stretch of words with a smallest period q (words q apart are the
same), at least ``max(LEAST, TIMES * q)`` words long, that no neighbouring word
extends. Ukkonen's algorithm builds the tree of the text and that of its
reversal; an Euler tour keeps, between one leaf and the next, the depth of the
node where they part, and a sparse table over these answers for any two places
how far the text goes on alike, ahead or back. Every run of two periods or more
has a root that is the longest Lyndon word at its start under the words' order
or the opposite one, so each place gives two candidates, and each is extended
both ways by one look at each tree.

A word of a run comes TIMES times in it. So words that come less often between
their neighbours of the same kind can be in no run: they cut the text, again
until nothing changes, and only what stays is put in a tree (pieces side by
side, kept apart by marks that come once). This loses no run and makes none.

Rules: a null text has no words and no runs; rows repeat as they come, with null
or repeated ids; a text of any length is one row, worked on in memory
proportional to its words; other columns are ignored; an empty table gives an
empty result; of runs with one exponent the first, then that of the smaller
period, counts as the greatest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor_spark.llm.common import slices, texts

#: Least number of words of a run, and of its periods.
LEAST, TIMES = 6, 4
OPEN = 1 << 60


def suffix_tree(text: list[int], size: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's tree of ``text``, whose last symbol comes once: edges by ``node * size + symbol``, and each node's label bounds.

    Symbols are below ``size``; node 0 is the root; a leaf's label has no end (``OPEN``).
    """
    edge: dict[int, int] = {}
    known = edge.get
    begin, end, link = [0], [0], [0]
    begun, ended, linked = begin.append, end.append, link.append
    node = at = length = todo = 0
    nodes = 1
    for i, symbol in enumerate(text):
        todo += 1
        fresh = 0  # the inner node made last, which still lacks its link
        while todo:
            if length:
                key = node * size + text[at]
                child = known(key)
                first = begin[child]
                span = end[child] - first
                if length >= span:
                    node = child
                    at += span
                    length -= span
                    continue
                after = text[first + length]
                if after == symbol:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                edge[key] = split = nodes
                edge[split * size + symbol] = nodes = split + 1
                edge[split * size + after] = child
                nodes += 1
                begun(first)
                ended(first + length)
                linked(0)
                begun(i)
                ended(OPEN)
                linked(0)
                begin[child] = first + length
                if fresh:
                    link[fresh] = split
                fresh = split
            else:
                key = node * size + symbol
                if fresh:
                    link[fresh] = node
                    fresh = 0
                if key in edge:
                    at, length = i, 1
                    break
                edge[key] = nodes
                nodes += 1
                begun(i)
                ended(OPEN)
                linked(0)
            todo -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at += 1
    return edge, begin, end


class Tree:
    """Euler tour of a suffix tree: ranks of the suffixes, and a sparse table over the depths between neighbours."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        stop = int(symbols.max(initial=-1)) + 1
        self.size = stop + 1
        edge, begin, end = suffix_tree([*symbols.tolist(), stop], self.size)
        self.keys, self.child = (np.fromiter(x, np.int64, len(edge)) for x in (edge.keys(), edge.values()))
        self.begin, self.end = begin, end
        leaves, depths = self.tour(stop_first=True)
        self.rank = np.empty(self.n + 1, np.int64)
        self.rank[leaves] = np.arange(self.n + 1)
        self.least = [np.array(depths, np.int32)]
        while len(self.least[-1]) > 1 << len(self.least) - 1:
            half, row = 1 << len(self.least) - 1, self.least[-1]
            self.least.append(np.minimum(row[:-half], row[half:]))

    def tour(self, stop_first: bool) -> tuple[list[int], list[int]]:
        """Starts of the suffixes in order, and the depth where each parts from the one before; the closing mark is least or greatest."""
        parent, symbol = np.divmod(self.keys, self.size)
        order = np.lexsort(((symbol + stop_first) % self.size, parent))
        parent, child = parent[order], self.child[order]
        same = parent[1:] == parent[:-1]
        sibling, eldest = (np.zeros(len(self.begin), np.int64) for _ in range(2))
        sibling[child[:-1][same]] = child[1:][same]
        heads = np.concatenate([[True], ~same])
        eldest[parent[heads]] = child[heads]
        sibling, eldest, begin, end = sibling.tolist(), eldest.tolist(), self.begin, self.end
        leaves, depths, waiting, above = [], [], [], []
        node, depth = eldest[0], 0
        while True:
            if sibling[node]:
                waiting.append(sibling[node])
                above.append(depth)
            if eldest[node]:
                depth += end[node] - begin[node]
                node = eldest[node]
                continue
            leaves.append(begin[node] - depth)
            if not waiting:
                return leaves, depths
            node, depth = waiting.pop(), above.pop()
            depths.append(depth)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes from a and from b begin with alike (a and b differ); constant time each."""
        one, two = self.rank[a], self.rank[b]
        low, high = np.minimum(one, two), np.maximum(one, two)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """End of the longest Lyndon word at each place: the next suffix that is smaller."""
    ranks, n = rank.tolist(), len(rank) - 1
    ends, stack = [n] * n, [n]
    for i in range(n - 1, -1, -1):
        mine = ranks[i]
        while ranks[stack[-1]] > mine:  # the empty suffix is the least, so the stack keeps it
            stack.pop()
        ends[i] = stack[-1]
        stack.append(i)
    return np.array(ends, np.int64)


def all_runs(symbols: np.ndarray, times: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the maximal stretches of ``times`` (two at least) periods or more, by start and period."""
    n = len(symbols)
    if n < 2:
        return (np.zeros(0, np.int64),) * 3
    ahead = Tree(symbols)
    opposite = np.empty(n + 1, np.int64)  # order of the opposite alphabet, in which the shorter of two is the smaller again
    opposite[ahead.tour(stop_first=False)[0]] = np.arange(n, -1, -1)
    place, end = np.tile(np.arange(n), 2), np.concatenate([lyndon_ends(ahead.rank), lyndon_ends(opposite)])
    on = np.zeros(2 * n, np.int64)
    inner = end < n
    on[inner] = ahead.common(place[inner], end[inner])
    # a run's first root begins in its first period, so the rest of the run lies ahead of it
    worth = on > (times - 2) * (end - place)
    place, end, on = place[worth], end[worth], on[worth]
    del ahead
    if not len(place):
        return (np.zeros(0, np.int64),) * 3
    back = Tree(symbols[::-1])
    before = np.zeros(len(place), np.int64)
    inner = place > 0  # reversed, the word before place p is at n - p
    before[inner] = back.common(n - place[inner], n - end[inner])
    period = end - place
    start, length = place - before, before + period + on
    found = np.unique(np.stack([start, period, length], axis=1)[length >= times * period], axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def dense_pieces(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Places that can be in a run: each word comes ``times`` times in its piece, and a piece has ``least`` words."""
    places = np.arange(len(symbols))
    while len(places):
        piece = np.cumsum(np.diff(places, prepend=places[0]) > 1)
        words = symbols[places]
        _, where, count = np.unique(piece * (int(symbols.max()) + 1) + words, return_inverse=True, return_counts=True)
        stay = (count[where] >= times) & (np.bincount(piece)[piece] >= least)
        if stay.all():
            break
        places = places[stay]
    return places


def find_runs(symbols: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of small numbers, by start and period."""
    symbols = np.asarray(symbols, np.int64)
    if len(symbols) < least or np.bincount(symbols).max() < times:
        return []
    places = dense_pieces(symbols, least, times)
    if not len(places):
        return []
    cuts = np.flatnonzero(np.diff(places) > 1) + 1
    _, dense = np.unique(symbols[places], return_inverse=True)
    joined = np.insert(dense, cuts, dense.max() + 1 + np.arange(len(cuts)))
    origin = np.insert(places, cuts, -1)
    start, length, period = all_runs(joined, times)
    keep = length >= np.maximum(least, times * period)
    return list(zip(origin[start[keep]].tolist(), length[keep].tolist(), period[keep].tolist()))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def sharpest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; ties: the smallest start, then the smallest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def scan(docs: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, number of runs, the sharpest run, digests of all runs and of the collapsed words.

    ``prepare`` may change a text's words first; ``with_text`` adds all runs and the collapsed text itself.
    """
    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
    if with_text:
        schema += ", runs array<struct<start long, length long, period long>>, collapsed string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                words = text.encode().split()  # bytes are split at ASCII white space
                if prepare:
                    words = prepare(doc_id, words)
                runs = find_runs(pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()) if len(words) >= LEAST else []
                best = sharpest(runs) if runs else (None,) * 3
                kept = b" ".join(collapsed(words, runs) if runs else words)
                row = {"doc_id": doc_id, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
                       "exponent_milli": 1000 * best[1] // best[2] if runs else None,
                       "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                       "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
                if with_text:
                    row |= {"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": kept.decode()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, arrow)

    long, text = pa.int64(), pa.string()
    fields = [(c.split()[0], text if c.endswith("string") else long) for c in schema.split(", ")[:8]]
    if with_text:
        fields += [("runs", pa.list_(pa.struct([("start", long), ("length", long), ("period", long)]))), ("collapsed", text)]
    arrow = pa.schema(fields)
    return texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(judge, schema)
