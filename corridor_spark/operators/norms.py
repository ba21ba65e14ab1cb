"""Global statistics applied to rows: fit once, then plain column expressions.

``fit`` reduces a table to a handful of numbers (one small row per job, never
the table) and the norms become literals, so scoring needs no join, no window
and works the same on a stream's micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor_spark.functions.numbers import number_or

#: Rows up to which one task may hold a column's distinct values; the result is the same on either side of it.
EXACT_ROWS = 1_000_000
_SKETCH = 10_000


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[Column, Iterable[float]]],
    exact_rows: int = EXACT_ROWS,
) -> dict[str, dict]:
    """Exact interpolated quantiles with ``n``, ``min`` and ``max`` of each named value.

    Large inputs are narrowed first: a mergeable sketch brackets each quantile,
    and only the values inside the bracket are ordered. A bracket still too
    large is narrowed again, so no task ever holds a whole column.
    """
    wanted = {name: (col, sorted({float(q) for q in qs})) for name, (col, qs) in wanted.items()}
    values = df.select(*[col.cast("double").alias(name) for name, (col, _) in wanted.items()])
    first = values.agg(
        *[
            agg.alias(f"{name}|{kind}")
            for name in wanted
            for kind, agg in (("n", F.count(name)), ("min", F.min(name)), ("max", F.max(name)))
        ]
    ).first()
    out = {name: {"n": first[f"{name}|n"], "min": first[f"{name}|min"], "max": first[f"{name}|max"], "q": {}}
           for name in wanted}
    small = [n for n in wanted if 0 < out[n]["n"] <= exact_rows]
    if small:
        row = values.agg(*[F.percentile(n, F.array(*map(F.lit, wanted[n][1]))).alias(n) for n in small]).first()
        for n in small:
            out[n]["q"] = dict(zip(wanted[n][1], row[n]))
    large = {(n, q): out[n] for n in wanted if out[n]["n"] > exact_rows for q in wanted[n][1]}
    for (name, q), value in _bracketed(values, large, exact_rows).items():
        out[name]["q"][q] = value
    for name, (_, qs) in wanted.items():
        if not out[name]["n"]:
            out[name]["q"] = dict.fromkeys(qs)
    return out


def _bracketed(values: DataFrame, known: dict[tuple[str, float], dict], exact_rows: int) -> dict[tuple[str, float], float]:
    """Quantiles of large columns, all together: a pass brackets them, one counts, and the last orders what the brackets hold.

    A bracket that misses its quantile is drawn wider in the next round.
    """
    if not known:
        return {}
    state = {k: {"low": s["min"], "high": s["max"], "below": 0, "inside": s["n"], "at": k[1] * (s["n"] - 1), "step": 3 / _SKETCH}
             for k, s in known.items()}
    of = lambda k, s: F.when(F.col(k[0]).between(s["low"], s["high"]), F.col(k[0]))
    place = lambda s: min(1.0, max(0.0, (s["at"] - s["below"]) / max(s["inside"] - 1, 1)))
    while wide := [k for k, s in state.items() if s["inside"] > exact_rows and s["low"] < s["high"] and s["step"] < 1]:
        cuts = values.agg(*[F.percentile_approx(of(k, state[k]), F.array(*[
            F.lit(min(1.0, max(0.0, place(state[k]) + d * state[k]["step"]))) for d in (-1, 1)]), F.lit(_SKETCH)).alias(str(i))
            for i, k in enumerate(wide)]).first()
        counts = values.agg(*[c.alias(f"{kind}{i}") for i, k in enumerate(wide) for kind, c in (
            ("below", F.count_if(F.col(k[0]) < cuts[i][0])), ("inside", F.count_if(F.col(k[0]).between(*cuts[i]))))]).first()
        for i, k in enumerate(wide):
            s, below, inside = state[k], counts[f"below{i}"], counts[f"inside{i}"]
            held = below <= s["at"] <= below + inside - 1 and inside < s["inside"]
            state[k] = s | ({"low": cuts[i][0], "high": cuts[i][1], "below": below, "inside": inside} if held else {"step": 4 * s["step"]})
    last = [k for k, s in state.items() if s["low"] < s["high"]]
    row = values.agg(*[F.percentile(of(k, state[k]), place(state[k])).alias(str(i)) for i, k in enumerate(last)]).first() if last else []
    return {k: s["low"] for k, s in state.items()} | dict(zip(last, row))


@dataclass(frozen=True)
class Norms:
    """Fitted bounds by column name."""

    bounds: dict[str, tuple[float, float]]

    def of(self, name: str, col: Column | None = None) -> Column:
        """The column scaled to 0–1 between its fitted bounds; constant columns give 0."""
        value = number_or(F.col(name) if col is None else col)
        low, high = self.bounds[name]
        if not high > low:
            return F.lit(0.0)
        return (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - F.lit(low)) / F.lit(high - low)


def fit_robust(df: DataFrame, columns: dict[str, float], exprs: dict[str, Column] | None = None,
               exact_rows: int = EXACT_ROWS) -> Norms:
    """Bounds of the robust norm: minimum → 0, upper quantile → 1.

    Null counts as 0. When the quantile is no larger than the minimum the
    maximum is the upper bound.
    """
    exprs = exprs or {}
    stats = exact_quantiles(
        df, {name: (number_or(exprs.get(name, F.col(name))), [q]) for name, q in columns.items()}, exact_rows
    )
    bounds = {}
    for name, q in columns.items():
        s = stats[name]
        if not s["n"]:
            bounds[name] = (0.0, 0.0)
            continue
        upper = s["q"][float(q)]
        bounds[name] = (s["min"], upper if upper > s["min"] else s["max"])
    return Norms(bounds)


def fit_scale(df: DataFrame, columns: Iterable[str], q: float = 0.95, exact_rows: int = EXACT_ROWS) -> Norms:
    """Bounds of the scale norm: 0 → 0, upper quantile (or maximum) of the non-negative values → 1."""
    columns = list(columns)
    stats = exact_quantiles(df, {c: (F.greatest(number_or(F.col(c)), F.lit(0.0)), [q]) for c in columns}, exact_rows)
    bounds = {}
    for c in columns:
        s = stats[c]
        upper = s["q"][float(q)] if s["n"] else 0.0
        bounds[c] = (0.0, upper if upper and upper > 0 else (s["max"] or 0.0))
    return Norms(bounds)


def fit_max(df: DataFrame, columns: Iterable[str], floor: float = 1.0) -> dict[str, float]:
    """Largest value of each column, at least ``floor``."""
    columns = list(columns)
    row = df.agg(*[F.max(number_or(F.col(c))).alias(c) for c in columns]).first()
    return {c: max(float(row[c] or 0.0), floor) for c in columns}


def weighted(parts: Iterable[tuple[float, Column]]) -> Column:
    """Weighted sum, added left to right."""
    total = None
    for weight, col in parts:
        term = F.lit(float(weight)) * col
        total = term if total is None else total + term
    return total
