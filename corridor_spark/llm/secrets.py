"""Secrets in text: fixed patterns, and tokens that a battery of randomness tests cannot tell from random.

A candidate is a run of 20 or more letters, digits and ``+/=_-``. A run that no
alphabet holds is cut at inner ``=``, and a piece that mixes ``+/`` with ``_-`` once
at the former and once at the latter; each piece of 20 or more characters is a
candidate of its own. The two cuts may overlap, and so may the spans that come of
them. A candidate's encoding is the smallest alphabet that holds it. Three tests ask whether it may be uniform
over that alphabet: chi-squared of the character counts, the runs above and
below the alphabet's middle, and the serial correlation of neighbours; a token
that fails them (Simes) is no secret. Passing is weak evidence for a short token,
so three tail probabilities under prose (counts as uneven as in prose, few
changes between letters, digits and cases, vowels and consonants in turn) are
combined by Fisher, and Benjamini and Hochberg's rule is applied within each band
of lengths over all candidates of the table. The rule works on a histogram of
the probabilities, whose bins are rounded against discovery.

Everything is a column expression. Positions come from the lengths of matches
and of what lies between them, summed in blocks, so a text with very many
matches costs no more than in proportion.

Rules: null text is empty; rows repeat as they come, with null or repeated ids;
texts without a match have counts 0, the hash of an empty string and empty
``spans``; an empty table gives an empty result; other columns are ignored; spans
that start together are ordered by kind as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor_spark.llm.common import stage, texts

#: Kinds in order: pattern, the group whose length counts, and its least length. "random" is the battery's.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),  # as AKIA[A-Z0-9]+ with 16 or more characters: a shorter rest cannot hold a longer match
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "random": ("[A-Za-z0-9+/=_-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the smallest alphabet up: what a token must match, and its characters in order.
ENCODINGS = [
    ("^[0-9a-f]+$", DIGITS + "abcdef"), ("^[0-9A-F]+$", DIGITS + "ABCDEF"), ("^[a-z]+$", LOWER), ("^[A-Z]+$", UPPER),
    ("^[A-Z2-7]+=*$", UPPER + "234567"), ("^[a-z0-9]+$", LOWER + DIGITS), ("^[A-Z0-9]+$", UPPER + DIGITS),
    ("^[A-Za-z]+$", UPPER + LOWER), ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS), ("^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
]
#: What a run that fits no encoding is cut into: at inner "=", and, where the families mix, at "+/" and at "_-".
_PAD = "(?:=+(?![A-Za-z0-9+/=_-]))?"
PIECE, MIXED, FAMILIES = f"[A-Za-z0-9+/_-]+{_PAD}", "[+/].*[_-]|[_-].*[+/]", (f"[A-Za-z0-9_-]+{_PAD}", f"[A-Za-z0-9+/]+{_PAD}")
SPAN = "array<struct<start:bigint,end:bigint,counted:bigint>>"
CHUNK = 256
#: Prose: the chance that two letters agree, that neighbours differ in class, and the correlation of neighbouring vowels.
AGREE, CHANGE, VOWELS = 0.065, 0.06, -0.35
ALPHA, RATE, FLOOR_P = 0.001, 0.01, 1e-5
BIN = 4.0


def let(value: Column, use) -> Column:
    """Name a value for an expression that uses it several times, so that it is worked out once."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, pattern: str, group: int) -> Column:
    """All matches as (start, end, length of the group), in code points."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    steps = F.zip_with(found, F.zip_with(counted, F.slice(gaps, 1, F.size(found)), lambda c, g: F.struct(c.alias("c"), g.alias("g"))),
                       lambda n, x: F.struct(x["g"].cast("long").alias("gap"), n.cast("long").alias("long"), x["c"].cast("long").alias("counted")))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / F.lit(CHUNK)).cast("int")),
                                lambda i: F.slice(s, i * CHUNK + 1, CHUNK))
    moved = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["long"])
    offsets = lambda chunks: F.aggregate(F.transform(chunks, moved), F.array(F.lit(0).cast("long")),
                                         lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

    def place(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), lambda a, x: F.struct(
            (a["at"] + x["gap"] + x["long"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["long"]).alias("end"),
                                                x["counted"].alias("counted")))).cast(SPAN).alias("out")), lambda a: a["out"])

    spans = let(let(steps, cut), lambda chunks: F.flatten(
        F.zip_with(chunks, F.slice(offsets(chunks), 1, F.size(chunks)), place)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """Chance that a standard normal is below z, by the logistic approximation, kept away from 0 and 1."""
    z = F.greatest(F.least(z, F.lit(6.0)), F.lit(-6.0))
    return 1.0 / (1.0 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def tested(token: Column) -> Column:
    """struct(ok, bin): whether the battery lets a token pass as random, and the bin of its probability under prose."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit("")
    for pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    base = F.struct(bare.alias("token"), alphabet.alias("alphabet"), F.split(bare, "(?!^)").alias("chars"))

    def measured(x: Column) -> Column:
        n, k = F.length(x["token"]).cast("double"), F.length(x["alphabet"]).cast("double")
        counts = F.transform(F.split(x["alphabet"], "(?!^)"), lambda c: n - F.length(F.replace(x["token"], c, F.lit(""))))
        place = F.transform(x["chars"], lambda c: F.instr(x["alphabet"], c).cast("double"))
        kind = F.transform(x["chars"], lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3))
        vowel = F.transform(x["chars"], lambda c: F.when(c.rlike("[aeiouAEIOU]"), 1.0).otherwise(0.0))
        return F.struct(n.alias("n"), k.alias("k"), F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
                        place.alias("place"), kind.alias("kind"), vowel.alias("vowel"))

    def pairs(values: Column, combine) -> Column:
        return F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values)), combine)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    def serial(values: Column, n: Column) -> Column:
        """Correlation of neighbours, from plain sums."""
        sums = F.struct((total(values) / n).alias("mean"), total(F.transform(values, lambda v: v * v)).alias("squares"),
                        total(pairs(values, lambda a, b: a * b)).alias("products"), (values[0] + F.element_at(values, -1)).alias("ends"))
        spread = lambda x: x["squares"] - n * x["mean"] * x["mean"]
        return let(sums, lambda x: F.when(spread(x) > 1e-9, (
            x["products"] - x["mean"] * (2 * n * x["mean"] - x["ends"]) + (n - 1) * x["mean"] * x["mean"]) / spread(x)).otherwise(1.0))

    def judged(m: Column) -> Column:
        n, k = m["n"], m["k"]
        chi = m["squares"] * k / n - n
        # may it be uniform over its alphabet?
        cube = F.pow(chi / (k - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))
        p_chi = 1 - normal_tail(cube / F.sqrt(2 / (9 * (k - 1))))
        high = total(F.transform(m["place"], lambda v: F.when(v > k / 2, 1.0).otherwise(0.0)))
        runs = 1 + total(pairs(m["place"], lambda a, b: F.when((a > k / 2) != (b > k / 2), 1.0).otherwise(0.0)))
        expected = 1 + 2 * high * (n - high) / n
        spread = (expected - 1) * (expected - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * normal_tail(-F.abs(runs - expected) / F.sqrt(spread))).otherwise(0.0)
        p_serial = 2 * normal_tail(-F.abs(serial(m["place"], n) + 1 / n) * F.sqrt(n))
        p = F.array_sort(F.array(p_chi, p_runs, p_serial))
        uniform = F.least(3 * p[0], 1.5 * p[1], p[2])
        # would prose look like that?
        uneven = F.greatest(k * AGREE - 1, F.lit(0.3))
        prose_chi = normal_tail((chi - (k - 1) - n * uneven) / F.sqrt(2 * (k - 1) + 4 * n * uneven))
        changes = total(pairs(m["kind"], lambda a, b: F.when(a != b, 1.0).otherwise(0.0)))
        prose_runs = normal_tail(-(changes - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
        prose_serial = normal_tail(-(serial(m["vowel"], n) - VOWELS) * F.sqrt(n))
        fisher = -(F.log(prose_chi) + F.log(prose_runs) + F.log(prose_serial))
        prose = F.exp(-fisher) * (1 + fisher + fisher * fisher / 2)
        return F.struct((uniform >= ALPHA).alias("ok"), F.floor(-F.log(prose) * BIN).cast("int").alias("bin"))

    usable = (F.length(alphabet) > 0) & (F.length(bare) >= 3)
    return F.when(usable, let(let(base, measured), judged)).otherwise(F.struct(F.lit(False).alias("ok"), F.lit(0).alias("bin")))


def matches(text: Column, pattern: str, at: Column) -> Column:
    """All matches as (start, end, token), moved by ``at``."""
    return F.zip_with(spans_of(text, pattern, 0), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda s, t: F.struct(
        (at + s["start"]).alias("start"), (at + s["end"]).alias("end"), t.alias("token")))


def pieces(run: Column) -> Column:
    """The run itself, or where it fits no encoding its pieces that are long enough."""
    fits = run["token"].rlike(ENCODINGS[-2][0]) | run["token"].rlike(ENCODINGS[-1][0])  # these two hold all others
    apart = lambda x: F.when(x["token"].rlike(MIXED), F.concat(*[matches(x["token"], f, x["start"]) for f in FAMILIES])).otherwise(F.array(x))
    cut = F.flatten(F.transform(matches(run["token"], PIECE, run["start"]), apart))
    return F.when(fits, F.array(run)).otherwise(F.filter(cut, lambda x: x["end"] - x["start"] >= KINDS["random"][2]))


def candidates(text: Column) -> Column:
    """Candidate tokens as (start, end, band of lengths, ok, bin)."""
    cut = F.flatten(F.transform(matches(text, KINDS["random"][0], F.lit(0).cast("long")), pieces))
    both = F.transform(cut, lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.floor(2 * F.log2(x["end"] - x["start"])).cast("int").alias("band"),
        tested(x["token"]).alias("test")))
    kind = "array<struct<start:bigint,end:bigint,band:int,test:struct<ok:boolean,bin:int>>>"
    return F.when(text.rlike(KINDS["random"][0]), both).otherwise(F.array().cast(kind))


def thresholds(found: DataFrame) -> dict[int, int]:
    """Least bin that counts as a discovery, per band of lengths; a row per band (lengths double every two) comes back."""
    bins = (found.select(F.explode("candidates").alias("c")).select("c.band", "c.test.ok", "c.test.bin")
            .groupBy("band", "bin").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("passing")))
    band = Window.partitionBy("band")
    rising = band.orderBy(F.desc("bin"))
    bins = bins.withColumn("tests", F.sum("n").over(band)).withColumn("found", F.sum("passing").over(rising))
    chance = F.exp(-F.col("bin") / BIN)  # no probability in the bin is larger
    good = bins.where((chance <= FLOOR_P) & (chance * F.col("tests") <= RATE * F.col("found")) & (F.col("passing") > 0))
    return {r["band"]: r["bin"] for r in good.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    ordered = F.array_sort(spans)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = []
    for name in BASE:
        pattern, group, least = KINDS[name]
        base.append(F.filter(spans_of(F.col("text"), pattern, group), lambda s: s["counted"] >= least).alias(name))  # noqa: B023
    found = stage(texts(docs).select("doc_id", *base, candidates(F.col("text")).alias("candidates")), "secrets")
    least = thresholds(found)

    def kind(spans: Column, i: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    fixed = F.concat(*[kind(F.col(name), i) for i, name in enumerate(BASE)])
    limit = F.create_map(*[F.lit(x) for pair in least.items() for x in pair]) if least else F.lit(None).cast("map<int,int>")
    passing = F.filter("candidates", lambda c: c["test"]["ok"] & F.coalesce(c["test"]["bin"] >= limit[c["band"]], F.lit(False)))
    apart = F.filter(passing, lambda c: ~F.exists("fixed", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return (found.withColumn("fixed", fixed)
            .select("doc_id", *[F.size(name).cast("long").alias(f"n_{name}") for name in BASE],
                    F.sha2(joined(F.col("fixed")), 256).alias("base_sha256"),
                    joined(F.concat("fixed", kind(apart, len(BASE)))).alias("spans")))
