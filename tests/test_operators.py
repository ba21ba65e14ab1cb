import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corridor_spark.operators import norms, ranks
from corridor_spark.operators.contains import contained_keys
from corridor_spark.operators.pyramid import build, cells_in_reach, nearest_anywhere
from corridor_spark.operators.nearest import LOCAL, NAMED, candidate_pairs, k_nearest, nearest, nearest_by_bounds, nearest_of_key, numbered, winning_pairs
from corridor_spark.plans.quality import duplicate_counts
from corridor_spark.sources.roads import with_bounds


def frame(spark, values, name="v"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 0.99, 1.0])
def test_bracketed_quantile_is_exact(spark, q):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=4000), np.repeat(7.0, 3000)])
    got = norms.exact_quantiles(frame(spark, values), {"v": (F.col("v"), [q])}, exact_rows=500)["v"]["q"][q]
    assert math.isclose(got, np.quantile(values, q), rel_tol=1e-9, abs_tol=1e-9)


def test_robust_norm_edges(spark):
    scaled = lambda values: [r[0] for r in (lambda df: df.select(norms.fit_robust(df, {"v": 0.95}).of("v").alias("n")))(frame(spark, values)).collect()]
    assert scaled([5, 5, 5]) == [0.0, 0.0, 0.0]
    assert scaled([0] * 99 + [10])[-1] == 1.0
    assert scaled([None, 10.0]) == [0.0, 1.0]
    assert scaled([float("nan"), 4.0]) == [0.0, 1.0]
    out = scaled([random.random() for _ in range(200)])
    assert min(out) == 0.0 and max(out) == 1.0
    assert norms.fit_robust(frame(spark, []), {"v": 0.95}).bounds["v"] == (0.0, 0.0)


def test_sliced_ranks_match_pandas(spark):
    rng = random.Random(1)
    pdf = pd.DataFrame({"g": [rng.choice("ab") for _ in range(600)], "v": [float(rng.randrange(90)) for _ in range(600)]})
    got = ranks.value_ranks(spark.createDataFrame(pdf), "v", ["g"], rows_per_slice=10).toPandas()
    want = pdf.assign(avg=pdf.groupby("g").v.rank(), low=pdf.groupby("g").v.rank(method="min")).drop_duplicates(["g", "v"])
    both = got.merge(want, on=["g", "v"])
    assert len(both) == len(got) == len(want)
    assert (both.rank_avg == both.avg).all() and (both.rank_min == both.low).all()


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, 300).astype(float)
    pdf = pd.DataFrame({"x": x, "y": x * 2 + rng.normal(size=300)})
    row = ranks.correlations(spark.createDataFrame(pdf), "x", "y").first()
    assert row["pearson"] == pytest.approx(pdf.x.corr(pdf.y), abs=1e-4)
    assert row["spearman"] == pytest.approx(pdf.x.rank().corr(pdf.y.rank()), abs=1e-4)
    assert ranks.correlations(spark.createDataFrame(pdf.head(1)), "x", "y").first()["pearson"] == 0.0


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(7)
    ways = []
    for w in range(400):
        x, y = -89.4 + rng.random() * 0.25, 13.55 + rng.random() * 0.2
        ways.append((w, x, y, x + rng.uniform(-0.01, 0.01), y + rng.uniform(-0.01, 0.01), f"d{w % 3}"))
    ways.append((900, -89.3, 13.6, -89.3, 13.6, "d0"))
    ways.append((901, -89.3, 13.6, -89.29, 13.61, "d0"))
    points = [(i, -89.42 + rng.random() * 0.3, 13.5 + rng.random() * 0.3, f"d{i % 3}") for i in range(300)]
    points.append((998, -89.3, 13.6, "d0"))
    points += [(2000 + i, -89.31, 13.62, "d1") for i in range(200)]
    pieces = spark.createDataFrame(ways, "way_id long, ax double, ay double, bx double, by_ double, dep string").cache()
    return spark.createDataFrame(points, "point_id long, x double, y double, dep string").cache(), pieces, points, ways


def brute(point, ways, lat_m=111_320.0):
    _, px, py, _ = point
    kx = 111_320.0 * math.cos(math.radians(py))
    best = []
    for w, ax, ay, bx, by, dep in ways:
        dx, dy, qx, qy = (bx - ax) * kx, (by - ay) * lat_m, (px - ax) * kx, (py - ay) * lat_m
        s = dx * dx + dy * dy
        t = max(0.0, min(1.0, (qx * dx + qy * dy) / s)) if s > 0 else 0.0
        best.append((math.hypot(qx - t * dx, qy - t * dy), w, dep))
    return sorted((math.floor(d * 1e6 + 0.5), w, d, dep) for d, w, dep in best)


@pytest.mark.parametrize("cell_pairs", [20_000_000, 100])
def test_nearest_is_brute_force(spark, network, cell_pairs):
    points, pieces, raw, ways = network
    got = {r["point_id"]: (r["way_id"], r["distance_m"]) for r in nearest(
        points, pieces, (200.0, 1000.0, 20_000.0), ["way_id"], cell_pairs=cell_pairs).collect()}
    assert len(got) == len(raw)
    for p in raw:
        _, way, distance, _ = brute(p, ways)[0]
        assert got[p[0]][0] == way and got[p[0]][1] == pytest.approx(distance, abs=1e-6)


def test_nearest_makes_no_pairs_that_lose(spark):
    """In one crowded place a point is paired with its winner alone, however the place is split; repeated pieces count once."""
    rng = random.Random(5)
    ways = [(w, x, y, x + rng.uniform(-2e-3, 2e-3), y + rng.uniform(-2e-3, 2e-3), "d0")
            for w, (x, y) in enumerate((rng.uniform(-89.20, -89.19), rng.uniform(13.70, 13.71)) for _ in range(400))]
    raw = [(i, rng.uniform(-89.20, -89.19), rng.uniform(13.70, 13.71), "d0") for i in range(600)] + [(700, -89.2, 13.7, "d0"), (701, -89.2, 13.7, "d0")]
    points = spark.createDataFrame(raw, "point_id long, x double, y double, dep string")
    pieces = spark.createDataFrame(ways + ways[:50], "way_id long, ax double, ay double, bx double, by_ double, dep string")
    listed = numbered(pieces, ["way_id"])
    assert listed.count() == len(ways)
    pairs = winning_pairs(points, listed, 1_000.0, LOCAL, [], "way_id", 13.71).collect()
    assert len(pairs) == len(raw)
    assert {(r["point_id"], r["way_id"]) for r in pairs} == {(p[0], brute(p, ways)[0][1]) for p in raw}
    got = nearest(points, pieces, (1_000.0, 5_000.0), ["way_id"], cell_pairs=10_000).collect()  # parts and shares of 100 rows
    assert sorted((r["point_id"], r["way_id"]) for r in got) == sorted((p[0], brute(p, ways)[0][1]) for p in raw)


def test_nearest_within_key(spark, network):
    points, pieces, raw, ways = network
    got = {r["point_id"]: r["way_id"] for r in nearest(points, pieces, (500.0, 30_000.0), ["way_id"], keys=["dep"]).collect()}
    for p in raw:
        assert got[p[0]] == next(w for _, w, _, dep in brute(p, ways) if dep == p[3])


def test_nearest_at_any_distance_and_latitude(spark):
    """Far points, points near the pole, roads of several pieces and a crowded cell."""
    rng = random.Random(8)
    ways = [(w // 3, x, y, x + rng.uniform(-0.5, 0.5), min(y + rng.uniform(-0.2, 0.2), 89.0), f"d{w // 3 % 2}")
            for w, (x, y) in enumerate((rng.uniform(-20, 20), rng.choice([10.0, 80.0, 84.0]) + rng.random()) for _ in range(90))]
    raw = [(i, rng.uniform(-30, 30), rng.choice([-40.0, 9.0, 80.0, 86.0]) + rng.random(), f"d{i % 2}") for i in range(120)]
    raw += [(500 + i, 3.0, 80.5, "d0") for i in range(50)]
    points = spark.createDataFrame(raw, "point_id long, x double, y double, dep string")
    pieces = spark.createDataFrame(ways, "way_id long, ax double, ay double, bx double, by_ double, dep string")
    for keys in ([], ["dep"]):
        got = {r["point_id"]: (r["way_id"], r["distance_m"]) for r in nearest(
            points, pieces, (1000.0, 50_000.0), ["way_id"], keys=keys, cell_pairs=500, beyond=True).collect()}
        assert len(got) == len(raw)
        for p in raw:
            _, way, distance, _ = next(b for b in brute(p, ways) if not keys or b[3] == p[3])
            assert got[p[0]][1] == pytest.approx(distance, abs=1e-5) and got[p[0]][0] == way
    by_key = {r["point_id"]: r["way_id"] for r in nearest_of_key(points, pieces, "dep", ["way_id"]).collect()}
    assert by_key == {p[0]: next(w for _, w, _, dep in brute(p, ways) if dep == p[3]) for p in raw}


@pytest.mark.parametrize("leaf", [1, 256])
def test_pyramid_is_brute_force(spark, leaf):
    """Far outliers, a crowded cell of pieces and of points, pieces one on the other, null places and repeated points."""
    rng = random.Random(leaf)
    ways = [(w, x, y, x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.1, 0.1), f"d{w % 2}")
            for w, (x, y) in enumerate((rng.uniform(-170, 170), rng.uniform(-60, 60)) for _ in range(150))]
    ways += [(1000 + w, 10 + rng.random() * 1e-3, 20 + rng.random() * 1e-3, 10.0, 20.0, "d0") for w in range(300)]
    ways += [(2000 + w, 50.0, 50.0, 50.0, 50.0, "d1") for w in range(40)]
    raw = [(i, rng.uniform(-179, 179), rng.uniform(-85, 85), f"d{i % 2}") for i in range(60)]
    raw += [(100 + i, 10 + rng.random() * 1e-3, 20 + rng.random() * 1e-3, "d0") for i in range(80)]
    raw += [(300, 50.0, 50.0, "d1"), (301, 50.0, 50.0, "d1"), (301, 50.0, 50.0, "d1"), (302, 179.0, -89.9, "d0"), (303, 10.0, 20.0, "d0")]
    odd = [(400, None, 1.0, "d0"), (401, 1.0, None, "d1"), (402, 1.0, 1.0, "none"), (403, 1.0, 1.0, None)]
    points = spark.createDataFrame(raw + odd, "point_id long, x double, y double, dep string")
    pieces = spark.createDataFrame(ways + [(5000, None, 1.0, 2.0, 3.0, "d0")], "way_id long, ax double, ay double, bx double, by_ double, dep string")
    for keys in ([], ["dep"]):
        want = Counter()
        for p in raw + ([] if keys else odd[2:]):
            _, way, distance, _ = next(b for b in brute(p, ways) if not keys or b[3] == p[3])
            want[p[0], way, round(distance, 4)] += 1
        got = nearest_anywhere(points, pieces, ["way_id"], LOCAL, keys, leaf=leaf, foot=True)
        assert Counter((r["point_id"], r["way_id"], round(r["distance_m"], 4)) for r in got.collect()) == want
        assert got.columns == ["point_id", "distance_m", "way_id", "foot"]
    assert nearest_anywhere(points, pieces.limit(0), ["way_id"], LOCAL).collect() == []
    assert nearest_anywhere(points.limit(0), pieces, ["way_id"], LOCAL).collect() == []


def test_pyramid_measures_few_pieces(spark):
    """A far place meets a few cells of each level, not the network."""
    rng = random.Random(4)
    ways = [(w, x, y, x + 1e-3, y + 1e-3) for w, (x, y) in enumerate((rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(20_000))]
    pieces = spark.createDataFrame(ways, "way_id long, ax double, ay double, bx double, by_ double")
    places = spark.createDataFrame([(i, rng.uniform(-90, 90), rng.uniform(-60, 60)) for i in range(200)], "_place long, x double, y double")
    pyramid = build(pieces, leaf=16)
    assert max(level.count() for level in pyramid.levels[:2]) <= 32
    cells = cells_in_reach(places, pyramid, LOCAL)
    assert cells.count() <= 200 * 12 and cells.select("_place").distinct().count() == 200


def test_no_pair_twice(spark, network):
    points, pieces, raw, _ = network
    pairs = candidate_pairs(points, pieces, 700.0, cell_pairs=100)
    assert pairs.count() == pairs.select("point_id", "way_id").distinct().count()


def test_k_nearest_is_brute_force(spark, network):
    points, pieces, raw, ways = network
    got = {}
    for r in k_nearest(points, pieces, 750.0, 5, ["way_id"], digits=2).orderBy("point_id", "candidate_rank").collect():
        got.setdefault(r["point_id"], []).append(r["way_id"])
    for p in raw[:100]:
        near = sorted((round(d + 1e-9, 2), w) for _, w, d, _ in brute(p, ways, 110_574.0) if d <= 750)
        assert got.get(p[0], []) == [w for _, w in near[:5]]


@pytest.mark.parametrize("cell_pairs", [2_500_000_000, 400])
def test_k_nearest_of_crowded_places_and_odd_rows(spark, cell_pairs):
    """Roads of several pieces, equal distances, repeated and null ids, one id in two places, points and pieces without a place."""
    rng = random.Random(11)
    ways = [(w // 2, x, y, x + rng.uniform(-2e-3, 2e-3), y + rng.uniform(-2e-3, 2e-3), f"d{w % 2}")
            for w, (x, y) in enumerate((rng.uniform(-89.22, -89.19), rng.uniform(13.70, 13.72)) for _ in range(300))]
    ways += [(1000 - w, -89.2, 13.7, -89.2 + w * 1e-5, 13.69, "d0") for w in range(30)]  # one end shared: the smallest ids win there
    ways += ways[:40]
    raw = [(i, rng.uniform(-89.23, -89.18), rng.uniform(13.69, 13.73), f"d{i % 2}") for i in range(120)]
    raw += [(500, -89.2, 13.7, "d0"), (501, -89.2, 13.701, "d0"), (501, -89.2, 13.701, "d0"), (502, -89.2, 13.7, "d0"), (502, -89.2003, 13.7, "d0"), (None, -89.2, 13.705, "d0")]
    odd = [(600, None, 13.7, "d0"), (601, float("nan"), 13.7, "d0"), (602, -89.2, 13.7, None), (603, 20.0, 13.7, "d0")]
    points = spark.createDataFrame(raw + odd, "point_id long, x double, y double, dep string")
    pieces = spark.createDataFrame([(*w, f"n{i % 3}") for i, w in enumerate(ways)] + [(7000, float("nan"), 13.7, -89.2, 13.7, "d0", "n")],
                                   "way_id long, ax double, ay double, bx double, by_ double, dep string, name string")
    names = {}
    for i, w in enumerate(ways):
        names[w[0]] = min(names.get(w[0], "z"), f"n{i % 3}")
    rx, ry = NAMED.reach(400.0, 13.73)
    for keys in ([], ["dep"]):
        for digits in (2, None):
            best = {}
            for p in raw + ([] if keys else odd[2:3]):
                cell = (p[0], math.floor(p[1] / rx), math.floor(p[2] / ry), p[3] if keys else "")
                for _, w, d, dep in brute(p, ways, 110_574.0):
                    if d <= 400 and (not keys or dep == p[3]):
                        best.setdefault(cell, {})[w] = min(d, best.get(cell, {}).get(w, math.inf))
            want = []
            for cell, found in best.items():
                near = sorted((round(d + 1e-9, 2) if digits else round(d, 6), w) for w, d in found.items())[:4]
                want += [(str(cell[0]), rank, w, names[w], pytest.approx(d, abs=1e-5)) for rank, (d, w) in enumerate(near, 1)]
            got = k_nearest(points, pieces, 400.0, 4, ["way_id", "name"], keys=keys, digits=digits, cell_pairs=cell_pairs)
            assert got.columns == ["point_id", "candidate_rank", "distance_m", "way_id", "name"]
            key = lambda r: (r[0], r[1], r[2])
            assert sorted(((str(r["point_id"]), r["candidate_rank"], r["way_id"], r["name"], r["distance_m"]) for r in got.collect()), key=key) == sorted(want, key=key)
    assert k_nearest(points.limit(0), pieces, 400.0, 4, ["way_id"]).collect() == [] == k_nearest(points, pieces.limit(0), 400.0, 4, ["way_id"]).collect()


def test_k_nearest_ranks_inside_blocks(spark, network):
    """No pair of a point with a road that is not among its k nearest leaves a block, and no shuffle follows."""
    points, pieces, _, _ = network
    plan = k_nearest(points, pieces, 750.0, 5, ["way_id"], digits=2)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan and "SortMergeJoin" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_nearest_by_bounds(spark, network):
    points, pieces, raw, ways = network
    polylines = with_bounds(pieces.select("way_id", F.array(F.array("ax", "ay"), F.array("bx", "by_")).alias("coords")))
    got = {r["point_id"]: r["way_id"] for r in nearest_by_bounds(points, polylines, 0.02, ["way_id"]).collect()}
    for p in raw:
        inside = [w for w in ways if min(w[1], w[3]) - 0.02 <= p[1] <= max(w[1], w[3]) + 0.02
                  and min(w[2], w[4]) - 0.02 <= p[2] <= max(w[2], w[4]) + 0.02]
        assert got.get(p[0]) == (brute(p, inside)[0][1] if inside else None)


def test_contained_keys_are_substrings(spark):
    texts = ["avenida corredor 12", "corredor 1", "sur", ""]
    keys = ["corredor 1", "corredor 12", "a", "xyz"]
    got = {(r["t"], r["key"]) for r in contained_keys(
        spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(k,) for k in keys], "key string"), "key"
    ).collect()}
    assert got == {(t, k) for t in texts for k in keys if k in t}


@pytest.mark.parametrize("most", [2, 100_000])
def test_contained_keys_of_long_texts_and_many_keys(spark, most):
    rng = random.Random(most)
    keys = sorted({"".join(rng.choices("abé ", k=rng.randint(1, 9))) for _ in range(25)}) + ["", None, "zz" * 2000]
    texts = ["".join(rng.choices("abé c", k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "ab" * 500_000 + "zz" * 2000, "zz"] + ["aab"] * 3
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [("a", 99)], "key string, n int")
    got = contained_keys(spark.createDataFrame([(t,) for t in texts], "t string"), "t", rows, "key", most)
    assert got.columns == ["t", "key", "n"]
    want = {(t, k, n) for t in texts if t for n, k in [*enumerate(keys), (99, "a")] if k and k in t}
    found = got.collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_duplicate_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None), ("b", None)], "uuid string, v int")
    got = {r["metric"]: r["value"] for r in duplicate_counts(df).collect()}
    assert got == {"raw_rows": 5.0, "exact_duplicate_rows": 2.0, "uuid_duplicate_rows": 3.0}


def test_capped_lists(spark):
    from corridor_spark.operators.tables import with_capped_lists

    rows = [("a", f"v{i % 12:02d}", f" x{i % 3} ") for i in range(60)] + [(None, "z", None), (None, " z ", ""), ("b", " ", None)]
    df = spark.createDataFrame(rows, "g string, v string, w string").repartition(5)
    grouped = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    got = {r["g"]: (r["n"], r["vs"], r["ws"]) for r in with_capped_lists(grouped, df, ["g"], {"vs": "v", "ws": "w"}, 8).collect()}
    assert got == {"a": (60, "; ".join(f"v{i:02d}" for i in range(8)) + "; +4 mas", "x0; x1; x2"), None: (2, "z", ""), "b": (1, "", "")}
    bare = with_capped_lists(grouped, df, ["g"], {"vs": "v"}, 2, more=False)
    assert {r["g"]: r["vs"] for r in bare.collect()} == {"a": "v00; v01", None: "z", "b": ""}
    assert with_capped_lists(grouped.limit(0), df.limit(0), ["g"], {"vs": "v"}, 2).collect() == []
