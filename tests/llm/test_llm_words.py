"""Word runs, spelling variants and language models against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor_spark.llm import common, language, queries, runs, spelling

ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c"), (None, None), (5, "x"), (5, "x"), (6, "   a a ß"), (7, "1 2 3 ²"),
       (8, "la " * 30_000), (9, "anagram " * 3 + "Straße×÷ ÀÉ " * 9)]


def documents(spark, rows):
    """Rows of documents with columns whose names clash with the operators' own."""
    full = [(*r, *(["en"] if len(r) < 3 else []), "s", 9, "own", 1, "mine") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, word string, n_runs long, bits string")


def test_staged_tables_of_a_result_not_yet_written(spark):
    """A scope removes what it staged when it is entered again, unless the result still reads it."""
    made = []
    for kept in (False, True, False):
        with common.scope("twice"):
            made.append(common.stage(spark.range(3), "rows"))
        if kept:
            common.leave("twice")
    assert made[1].count() == 3 and made[2].count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        made[0].count()
    common.discard(made[1])


# ---- runs ----------------------------------------------------------------------------------------------------------


def brute_runs(w, least, times):
    found = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            if i > start and length >= max(least, times * q):
                if not any(all(w[start + t] == w[start + t + p] for t in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, kinds = rng.randint(0, 45), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(kinds) for _ in range(n)]
        if n and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 7)
            w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
        assert runs.find_runs(np.array(w, int)) == brute_runs(w, 6, 4)
        start, length, period = runs.all_runs(np.array(w, int))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist())) == sorted(brute_runs(w, 2, 2))


def test_common_is_the_longest_common_extension():
    rng = random.Random(5)
    w = np.array([rng.randrange(2) for _ in range(120)])
    tree = runs.Tree(w)
    a, b = np.array([(i, j) for i in range(120) for j in range(120) if i != j]).T
    for i, j, got in zip(a, b, tree.common(a, b)):
        want = 0
        while max(i, j) + want < 120 and w[i + want] == w[j + want]:
            want += 1
        assert got == want


def test_runs_of_documents(spark):
    rng = random.Random(8)
    rows = ODD + [(100 + i, " ".join(rng.choices(["a", "b", "ü", "c."], k=rng.randint(0, 60)))) for i in range(120)]
    rows += [(300 + i, " ".join(rng.choices(["la", "li", "lu"], k=rng.randint(1, 6)) * rng.randint(1, 9))) for i in range(40)]
    want = Counter()
    for doc_id, text in rows:
        w = queries.echoed(doc_id, (text or "").encode().split())
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0 and w:  # the contract's words, one by one
            h, old = zlib.crc32(str(doc_id).encode()), text.encode().split()
            n, g = len(old), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert w == [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        found = brute_runs(w, 6, 4) if len(w) < 1000 else runs.find_runs(np.unique(w, return_inverse=True)[1])
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
             hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()] += 1
    docs = documents(spark, rows)
    assert Counter(map(tuple, runs.scan(docs, queries.echoed).collect())) == want
    full = {r["doc_id"]: r for r in runs.scan(docs.where("doc_id = 8"), with_text=True).collect()}
    assert full[8]["collapsed"] == "la" and [tuple(x) for x in full[8]["runs"]] == [(0, 30_000, 1)]
    assert runs.scan(docs.limit(0), queries.echoed).count() == 0


# ---- spelling ------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute_variants(words):
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(beside[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("lot", [3, 512])
def test_variants_are_those_of_brute_force(spark, monkeypatch, lot):
    monkeypatch.setattr(spelling, "LOT", lot)
    rng = random.Random(lot)

    def edit(w):
        k, c = rng.randrange(len(w)), rng.choice("abé")
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    base = ["".join(rng.choices("abé", k=rng.randint(7, 11))) for _ in range(60)] + ["x" * 2000, "x" * 2001, "y" + "x" * 2000]
    base += [w + c for w in ("stemword", "endings") for c in "abcdefghijklmnop"]  # one block of many words
    words = {w: rng.choice([2, 2, 3, 25, 300, 4000, 50_000]) for w in base + [edit(w) for w in base for _ in range(3)] if len(w) >= 7}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert Counter(map(tuple, got.collect())) == Counter(brute_variants(words))


def test_word_counts_and_empty_tables(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choices("abcÀé", k=rng.randint(5, 9))) for _ in range(30)]
    rows = ODD + [(i, " ".join(rng.choices(pool, k=40)).title() + "--xyzzyxy_1") for i in range(50)] + [(None, "Wordless words wordless")]
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling.word_counts(documents(spark, rows), queries.misspelt)
    assert dict(map(tuple, got.collect())) == want
    assert Counter(map(tuple, spelling.variants(got).collect())) == Counter(brute_variants(want))
    assert spelling.variants(spelling.word_counts(documents(spark, rows).limit(0))).count() == 0


# ---- language ------------------------------------------------------------------------------------------------------


class BruteModel:
    """Interpolated Kneser-Ney over whole words, straight from the definition."""

    def __init__(self, words, order):
        self.order = order
        raw, self.counts = Counter(), [Counter() for _ in range(order + 1)]
        for word, n in words.items():
            p = language.BEGIN + word + language.END
            for t in range(1, len(p)):
                for k in range(1, order + 1):
                    if t - k + 1 >= 0:
                        raw[p[t - k + 1 : t + 1]] += n
        follows = defaultdict(set)
        for g in raw:
            follows[g[1:]].add(g[0])
        for g, n in raw.items():
            self.counts[len(g)][g] = n if len(g) == order or g[0] == language.BEGIN else len(follows[g])
        self.symbols = len(self.counts[1]) + 1
        self.cut = [0]
        for k in range(1, order + 1):
            one, two = (sum(n == x for n in self.counts[k].values()) for x in (1, 2))
            self.cut.append(one / (one + 2 * two) if one and two else 0.5)

    def p(self, gram):
        if not gram:
            return 1 / self.symbols
        k, of = len(gram), [n for g, n in self.counts[len(gram)].items() if g[:-1] == gram[:-1]]
        if not of:
            return self.p(gram[1:])
        return max(self.counts[k][gram] - self.cut[k], 0) / sum(of) + self.cut[k] * len(of) / sum(of) * self.p(gram[1:])

    def bits(self, word):
        p = language.BEGIN + word + language.END
        return -sum(math.log2(self.p(p[max(0, t - self.order + 1) : t + 1])) for t in range(1, len(p)))


def test_costs_are_those_of_the_definition(spark):
    rng = random.Random(6)
    texts = {x: [" ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)) for _ in range(3)]
             for x, letters in (("xx", "aaabcd"), ("yy", "aéññbz"))}
    learned = documents(spark, [(i, t, x) for x, ts in texts.items() for i, t in enumerate(ts)])
    model = language.estimate(language.word_table(learned))
    assert model.languages == ["xx", "yy"]
    asked = [(1, "abc, ABBA! ñandú 12 zzzzzq"), (2, None), (3, "7 ² _"), (4, "a" * 5000), (4, "a" * 5000), (None, "Bad cab")]
    exact = [BruteModel(Counter(language.words_of(" ".join(texts[x]))), language.ORDER) for x in model.languages]
    docs = documents(spark, asked)
    by_arrays, by_join = (Counter(map(str, way(docs, model, ("lang",)).collect())) for way in (language._by_arrays, language._by_join))
    assert by_arrays == by_join
    for r in language._by_arrays(docs.where("doc_id = 1 or doc_id is null"), model, ()).collect():
        words = language.words_of(dict((i, t) for i, t in asked)[r["doc_id"]])
        assert r["symbols"] == sum(len(w) + 1 for w in words)
        for got, brute in zip(r["bits"], exact):
            assert got / language.MICRO == pytest.approx(sum(map(brute.bits, words)), abs=1e-4)


def test_languages_of_held_out_texts(spark):
    rng = random.Random(9)
    made = {"de": "sch ung ver ich keit ein der".split(), "fr": "eau tion ent les qué oux ai".split(), "es": "ción ado los ñue que rra es".split()}
    rows = [(i, " ".join("".join(rng.choices(made[x], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))), x)
            for i, x in enumerate(rng.choices(list(made), k=400))]
    rows += [(900, None, "de"), (901, "12 34", "fr"), (902, "", None), (903, "xqzw wqzx kjxq zzqx " * 30, None), (None, "les eaux", None)]
    docs = documents(spark, rows)
    model = language.learn(docs.where(F.col("doc_id").isNotNull() & ~language.in_fold("doc_id")))
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903]["rejected"] and got[903]["lang_pred"] in made and not any(got[i]["rejected"] for i in held[:20])
    assert got[None]["lang_pred"] == "fr"
    folds = docs.where("doc_id is not null").select("doc_id", language.in_fold("doc_id").alias("held")).collect()
    assert {r["doc_id"] for r in folds if r["held"]} == {i for i in truth if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    # what a prediction sees: neither its language nor its id or source
    other = docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit("t")).withColumn("doc_id", F.col("doc_id") + 10_000)
    again = {r["doc_id"] - 10_000: r for r in language.identify(other.where("doc_id is not null"), model).collect()}
    assert all((again[i]["lang_pred"], again[i]["score"]) == (got[i]["lang_pred"], got[i]["score"]) for i in held)


def test_all_labelled_texts_count_and_calibrate(spark):
    rng = random.Random(3)
    made = {"de": "sch ung ver ich keit".split(), "fr": "eau tion ent les oux".split()}
    rows = [(i, " ".join("".join(rng.choices(made[x], k=2)) for _ in range(rng.randint(1, 30))), x) for i, x in enumerate(rng.choices(list(made), k=300))]
    docs = documents(spark, rows + [(400, "12", "es"), (401, None, "de"), (402, "ungesehen", None)])
    model, whole = language.learn(docs), language.estimate(language.word_table(docs))
    as_rows = lambda m: sorted((r["gram"], r["costs"], r["leave"]) for r in m.grams.collect())
    assert as_rows(model) == as_rows(whole)
    measured = [r for r in language.measure(docs, whole, "lang").collect() if r["symbols"] and r["lang"]]
    assert len(measured) == 300
    for i, lang in enumerate(whole.languages):
        own = [(r["bits"][i] / language.MICRO, r["symbols"]) for r in measured if r["lang"] == lang]
        mean = sum(b for b, _ in own) / sum(s for _, s in own)
        spread = math.sqrt(sum((b / s - mean) ** 2 * s for b, s in own) / len(own))
        assert model.usual[lang] == pytest.approx((mean, spread), abs=1e-6)
    got, once = language.identify(docs, model), language.label(docs, F.lit(True))
    assert Counter(map(str, got.collect())) == Counter(map(str, once.collect()))


def test_languages_without_anything_learned(spark):
    docs = documents(spark, [(1, "word", None), (2, None, None)])
    got = language.identify(docs, language.learn(docs))
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got.collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    one = documents(spark, [(1, "word words", "en")])
    assert language.identify(docs, language.learn(one)).where("doc_id = 1").first()["lang_pred"] == "en"
    assert language.identify(docs.limit(0), language.learn(one)).count() == 0
    assert language.identify(docs, language.learn(docs.limit(0))).count() == 2
