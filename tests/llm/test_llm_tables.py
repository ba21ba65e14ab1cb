"""Mixing, search, URL filter, components, the pipeline and the registration."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corridor_spark.llm import components, mixing, ngram_join, quality, queries, topk, url_filter

WORD = "[^\x20\x09-\x0d]+"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True, 2.0) for r in rows], "doc_id long, text string, source string, key int, size string, kept boolean, start double")


def mix_rows(seed, sources="abcdef", n=120):
    rng = random.Random(seed)
    rows = [(i, " \n".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(sources)) for i in range(n)]
    return rows + [(None, "x y z", None), (n, None, "a"), (n + 1, "", None), (n + 2, "one " * 3000, "b"), (n + 3, "same", "c"), (n + 3, "same", "c")]


def fair_targets(rows, weights=(5, 2, 1), most=3):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(WORD, text or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, total = {}, sum(size.values())
    open_, left = set(names), float(total)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * size[s]}
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: float(most * size[s]) for s in over}
        left -= sum(most * size[s] for s in over)
        open_ -= over
    return size, target


@pytest.mark.parametrize("block_words", [7, 512])
def test_mix_gives_targets(spark, block_words):
    rows = mix_rows(1)
    size, target = fair_targets(rows)
    docs = documents(spark, rows)
    got = [tuple(r) for r in mixing.taken_words(docs, block_words=block_words).collect()]
    again = [tuple(r) for r in mixing.taken_words(docs.repartition(3), block_words=block_words).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    own = Counter((i, len(re.findall(WORD, t or ""))) for i, t, _ in rows)
    assert Counter((r[0], r[1]) for r in got) == own
    taken = defaultdict(int)
    source = {i: s for i, _, s in rows}
    for i, n, total, goal, words in got:
        assert 0 <= words <= 3 * n and total == size[source[i]] and goal == pytest.approx(target[source[i]])
        taken[source[i]] += words
    for s, goal in target.items():
        assert abs(taken[s] - goal) <= 0.5
    # every document is taken as often as its source goes round, give or take the last round
    for i, n, total, goal, words in got:
        if n:
            assert math.floor(round(goal) / total) * n <= words <= (math.floor(round(goal) / total) + 1) * n


def test_schedule_mixes_at_every_length(spark):
    docs = documents(spark, mix_rows(2, n=400))
    _, sources = mixing.plan_sources(docs, block_words=16)
    share = {r["sid"]: r["n_slots"] for r in sources.collect()}
    total = sum(share.values())
    slots = mixing.schedule(sources).orderBy("slot", "sid").collect()
    assert Counter(r["sid"] for r in slots) == Counter({s: n for s, n in share.items() if n})
    seen = Counter()
    for j, r in enumerate(slots[: total - 20], 1):
        seen[r["sid"]] += 1
        assert abs(seen[r["sid"]] - j * share[r["sid"]] / total) <= 6
    blocks = defaultdict(list)
    for r in slots:
        blocks[r["sid"]].append((r["round"], r["block"]))
    assert all(b == sorted(set(b)) for b in blocks.values())  # rank after rank, none twice


def test_mixed_documents(spark):
    rows = mix_rows(3)
    docs = documents(spark, rows)
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    taken = Counter()
    for r in mixing.taken_words(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    have, text = Counter(), {i: t or "" for i, t, _ in rows}
    for r in got.collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r["key"] == 1
        have[r["doc_id"]] += len(re.findall(WORD, r["text"]))
    assert have == +taken
    assert mixing.mix_documents(documents(spark, [])).collect() == []
    assert mixing.taken_words(documents(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.taken_words(documents(spark, [(1, "", "a"), (2, None, None)])).orderBy("doc_id").collect()] == [
        (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# ---- search --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4, 64, 2048])
def test_top_k_is_exact(spark, block):
    rng = random.Random(block)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1e-9, rng.uniform(-1, 1)]) for _ in range(5)]) for i in range(200)]
    rows += [(500 + i, [0.25, 0.25, 0.25, 0.25, 0.25]) for i in range(40)]  # ties
    odd = [(600, None), (650, []), (700, [float("nan")] * 5), (750, [1.0, None, 1.0, 1.0, 1.0]), (800, [float("inf")] + [0.0] * 4), (None, [0.9] * 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd + rows[:3]], "vec_id long, embedding array<float>, query_id string, rank int")
    vectors = docs.where(topk.usable("embedding")).select("vec_id", topk.quantised("embedding").alias("values"))
    got = sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5, block).collect()))
    values = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in [*rows, (None, [0.9] * 5)]}
    want = []
    for q in (i for i in values if i is not None and i % 50 == 0):
        scores = sorted(((sum(a * b for a, b in zip(values[q], v)), i) for i, v in values.items() if i != q),
                        key=lambda x: (-x[0], x[1] is None, x[1]))
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(scores[:5])]
    assert [(q, s) for q, _, _, s in got] == [(q, s) for q, _, _, s in sorted(want, key=lambda w: (w[0], w[1]))]
    assert {g for g in got if g[2] is not None} == {w for w in want if w[2] is not None}


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, values array<long>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1, 2]), (1, [3, -4]), (50, [10**9, 10**9]), (100, [7])], schema)
    got = sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(0, 1, 50, 3 * 10**9), (0, 2, 1, -5), (50, 1, 0, 3 * 10**9), (50, 2, 1, -(10**9))]


def test_threshold_search_stops_early():
    rows = np.zeros((10_000, 2))
    rows[:, 0] = np.arange(10_000)
    order, read = np.argsort(rows, axis=0, kind="stable"), []

    class Rows(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]

    found, scores = topk.threshold_search(np.array([1.0, 0.0]), -1, rows.view(Rows), np.arange(10_000), order,
                                          np.take_along_axis(rows, order, axis=0), 5)
    assert found.tolist() == [9999, 9998, 9997, 9996, 9995] and sum(read) < 100


# ---- URLs ----------------------------------------------------------------------------------------------------------


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def best_rule(host, path):
    fits = [(len(r), -i, r, v) for i, (v, r) in enumerate(url_filter.RULES)
            for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_url_rules_and_model(spark):
    rng = random.Random(1)
    tails = ["", "/", "/en/", "/en/x", "/en", "/es/1", "/fr/", "?q=/en/", "#/en/", "/EN/", "/é/日"]
    hosts = ["com", "a.com", "example.com", "www.example.com", "x.www.example.com", "xexample.com", "Example.COM", "net", "b.net", "org", "İ.net", ""]
    urls = [None, "", "x", "://", "http://", "a://b://c.com/", "http:/a.com/", "y" * 5000] + [f"http://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(300)]
    pages = spark.createDataFrame([(i if i else None, u, "x", 2) for i, u in enumerate(urls)] + [(5, urls[20], "x", 2)] * 2,
                                  "page_id long, url string, rule string, host int")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"] is None or r["page_id"] == 5:
            continue
        host, path = url_parts(urls[r["page_id"]])
        rule, verdict = best_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    assert all(r["verdict"] == "allow" for r in got if not r["host"] and not r["path"])
    assert url_filter.judge(pages.limit(0)).collect() == []
    assert {r["verdict"] for r in url_filter.judge(pages.where("url LIKE '%.org%' OR url LIKE '%/org/%'")).collect()} <= {"allow"}


def test_url_labels_hold_a_rare_verdict(spark):
    rows = [(f"h{i}.com", f"/en/{i}", "allow") for i in range(3000)] + [("a.net", f"/es/{i}", "block") for i in range(2)]
    found = spark.createDataFrame(rows + rows, "host string, path string, decided string")
    got = Counter(r["decided"] for r in url_filter.labelled(found, 20).collect())
    assert got == {"allow": 10, "block": 2}
    pages = spark.createDataFrame([(i, f"http://h{i}.com/en/{i}") for i in range(6000)] + [(9000, "http://a.net/es/1"), (9001, "http://b.net/es/2"), (9002, "http://a.org/es/1")],
                                  "page_id long, url string")
    said = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages).where("page_id >= 9000").collect()}
    assert said == {9000: "block", 9001: "block", 9002: "block"}


def test_url_model_on_held_out_rows():
    rng = random.Random(2)
    rows = [(f"{rng.choice(['www', 'm', 'blog'])}.h{rng.randrange(999)}.example.{t}", f"/{p}/{rng.randrange(9999)}", p in ("es", "fr"))
            for t in ("net", "org") for p in ("en", "de", "es", "fr") for _ in range(100)]
    rng.shuffle(rows)
    hosts, paths, bad = map(list, zip(*rows))
    weights, bias = url_filter.fit(hosts[:400], paths[:400], np.array(bad[:400]))
    said = url_filter.scores(hosts[400:], paths[400:], weights, bias) > 0
    assert np.mean(said == np.array(bad[400:])) >= 0.97


# ---- components, pipeline, registration ----------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 50)]
    rng.shuffle(links)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    want = {(x, top(x)) for x in list(up) if top(x) != x}
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    pool = [f"word{i}" for i in range(400)]
    prose = lambda n: "\n".join(" ".join(rng.choices(pool, k=12)) for _ in range(n))
    passage = " ".join(rng.choices(pool, k=60))
    clean = [(i, prose(rng.randint(8, 20))) for i in range(30)]
    near = clean[3][1].replace("\n", " ").split()
    near[10] = "changed"
    rows = clean + [(100, clean[0][1]), (101, prose(6) + "\n" + passage), (102, prose(7) + "\n" + passage), (103, "too short"), (104, None),
                    (105, "$$$ " * 90), (106, " ".join(near))]
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 4}", len(t or ""), 9) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, key int")
    out = {}
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        done = step(spark, docs, "")
        if number < 4:
            assert done.columns == docs.columns, name
            done.write.parquet(f"{tmp_path}/{number}")
            docs = spark.read.parquet(f"{tmp_path}/{number}")
            out[number] = {r["doc_id"]: r["text"] for r in docs.collect()}
        else:
            last = done.collect()
    assert set(out[0]) == {i for i, _ in rows} - {103, 104, 105}
    assert set(out[1]) == set(out[0]) - {100}
    assert passage in out[1][101] and passage not in out[1][102]
    assert all(out[1][i] == t for i, t in clean)
    assert set(out[2]) == set(out[1]) - {106}
    assert set(out[3]) <= set(out[2])
    assert {r["doc_id"] for r in last} == set(out[3]) and all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_registered():
    from __spark_entry__ import oracle_sql
    from __spark_entry__ import queries as registered

    names = set(registered())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d+_", n)}
    assert "pipeline" in names and set(oracle_sql()) <= names and set(queries.QUERIES) <= names
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "source mix", "BPE"]
    assert (ngram_join.WORDS, ngram_join.PERCENT) == (5, 80) and list(quality.RULES)[:2] == ["too_short", "repeats"]
