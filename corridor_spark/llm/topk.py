"""Exact inner-product search by the threshold algorithm over sorted per-dimension lists.

Candidates lie in blocks. A block keeps, per dimension, its candidates sorted by
that component. A query walks the lists from the end that favours it (large
components where its own is positive, small where it is negative), scores in
full every candidate that shows up, and stops once its k-th score beats the
bound: the sum over dimensions of its component times the value the list has
come to. No candidate below that depth can score more than the bound. Depth
grows geometrically; ties with the bound go on, so equal scores are all seen.
Each query meets every block, in (candidate block, query block) groups of
bounded size, and the blocks' answers are merged by one window.

Rules: vectors that are null, empty or hold null or non-finite components take
no part; rows repeated in id and vector count once; a query's own id is never
among its candidates; only vectors of one length meet; ties go to the smaller
id; with fewer than k candidates all are returned; null ids are candidates after
all others and no queries; empty tables give empty results; scores must fit
into a long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


def quantised(vector: str, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def threshold_search(query: np.ndarray, own: float, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, ranked: np.ndarray,
                     k: int, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Best k (ids, scores) of one block; ``order`` and ``ranked`` hold each dimension's rows and values, ascending."""
    n = len(rows)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = ids == own
    best_id, best = np.zeros(0, ids.dtype), np.zeros(0, rows.dtype)
    while True:
        depth = min(depth, n)
        shown = np.zeros(n, bool)
        shown[order[n - depth :, up].ravel()] = True
        shown[order[:depth, down].ravel()] = True
        if depth == n:
            shown[:] = True
        fresh = np.flatnonzero(shown & ~seen)
        seen |= shown
        score = rows[fresh] @ query
        best_id, best = np.append(best_id, ids[fresh]), np.append(best, score)
        if len(best) > k:
            least = np.partition(best, len(best) - k)[len(best) - k]
            stay = best >= least
            best_id, best = best_id[stay], best[stay]
            first = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[first], best[first]
        bound = query[up] @ ranked[n - depth, up] + query[down] @ ranked[depth - 1, down]
        if depth == n or len(best) == k and best.min() > bound:
            return best_id, best
        depth *= 4


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block: int = BLOCK) -> DataFrame:
    """Best k rows of ``vectors`` (vec_id, values array<long>) for each of its rows that ``queries`` selects."""
    rows = vectors.groupBy("vec_id", "values").agg(F.count("*").alias("times"), F.size("values").alias("dim"))
    n, m = rows.agg(F.count("*"), F.count(F.when(queries & F.col("vec_id").isNotNull(), 1))).first()
    n_blocks, q_blocks = -(-n // block) or 1, -(-m // block) or 1
    spread = lambda salt, size: F.pmod(F.xxhash64("vec_id", "values", F.lit(salt)), F.lit(size)).cast("int")
    facing = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    have = rows.select("vec_id", "values", "dim", spread(1, n_blocks).alias("cb"), facing(q_blocks).alias("qb"))
    ask = (rows.where(queries & F.col("vec_id").isNotNull())
           .select("vec_id", "values", "dim", facing(n_blocks).alias("cb"), spread(2, q_blocks).alias("qb")))

    def search(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("Int64")
        if not len(asked) or not len(there):
            return empty
        c, q = (np.stack(x["values"].to_numpy()).astype(np.int64) for x in (there, asked))
        if float(np.abs(c).max()) * float(np.abs(q).max()) * c.shape[1] < 2**53:  # then doubles hold every sum exactly
            c, q = c.astype(float), q.astype(float)
        ids = there["vec_id"].astype("Int64").fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
        order = np.argsort(c, axis=0, kind="stable")
        ranked = np.take_along_axis(c, order, axis=0)
        out = [(own, *threshold_search(x, own, c, ids, order, ranked, k)) for own, x in zip(asked["vec_id"].tolist(), q)]
        found = pd.DataFrame({"query_id": np.repeat([x[0] for x in out], [len(x[1]) for x in out]),
                              "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})
        return found.astype("Int64")

    found = (ask.groupBy("dim", "cb", "qb").cogroup(have.groupBy("dim", "cb", "qb"))
             .applyInPandas(search, "query_id long, vec_id long, score long").distinct())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .withColumn("vec_id", F.when(F.col("vec_id") < 2**63 - 1, F.col("vec_id"))).select("query_id", "rank", "vec_id", "score"))
