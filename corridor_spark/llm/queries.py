"""Registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor_spark.llm import (
    bpe, language, line_dedup, mixing, ngram_join, pii, quality, runs, secrets, spelling, token_files, topk, url_filter)
from corridor_spark.llm.common import load, stage_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(load(spark, sf_dir, "documents"))


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_root(spark)}/token-ids-{uuid.uuid4().hex}"
    token_files.write(load(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), None, end_id=1)
    return token_files.read_documents(spark, folder)


@query
def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(load(spark, sf_dir, "documents"))


@query
def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").where(topk.usable("embedding"))
    return topk.top_k(vectors.select("vec_id", topk.quantised("embedding").alias("values")), F.col("vec_id") % 50 == 0).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op1_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


@query
def op5_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(load(spark, sf_dir, "pages"))


@query
def op8_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(load(spark, sf_dir, "documents"))


@query
def op10_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.labels(load(spark, sf_dir, "documents"), words=3, percent=90)


@query
def op9_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(load(spark, sf_dir, "documents"))


def echoed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, in a tenth of the documents with the rest from some word on replaced by repeats of its beginning."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.scan(load(spark, sf_dir, "documents"), echoed)


def misspelt(doc_id: int | None, run: str) -> str:
    """The run, without one of its code points where its hash with the document says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % 31 else run[:at] + run[at + 1 :]


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(load(spark, sf_dir, "documents"), misspelt))


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = language.label(docs, F.col("doc_id").isNotNull() & ~language.in_fold("doc_id"))
    return found.select("doc_id", language.in_fold("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_symbol", "rejected")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op2_source_mix"] = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
                  md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), '-'), '|', coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, CAST([5, 2, 1][(sid - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(words * 3 AS DOUBLE) AS cap FROM r),
l AS (SELECT *, cap / weight AS ratio,
             (CAST(sum(words) OVER () AS DOUBLE)
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / (sum(weight) OVER ()
                - coalesce(sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             AS level FROM w),
f AS (SELECT source, words,
             least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, sid LIMIT 1), 0e0) * weight) AS target FROM l),
t AS (SELECT *, CAST(floor(target + 0.5e0) AS BIGINT) AS take FROM f),
p AS (SELECT doc_id, source, size,
             coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target,
       CAST(CASE WHEN size = 0 THEN 0
                 ELSE (take // words) * size + greatest(0, least(a + size, take % words) - a) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

ORACLES["op6_quality_cascade"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
v AS (SELECT row, generate_subscripts(w, 1) AS i, w FROM d),
t AS (SELECT row, i, [w[i], w[i + 1], w[i + 2]] AS tri FROM v WHERE i + 2 <= len(w)),
o AS (SELECT row, i FROM t QUALIFY count(*) OVER (PARTITION BY row, tri) > 1),
m AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM o) GROUP BY row),
k AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
g AS (SELECT row, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM k
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(lines, 0) AS lines
      FROM d LEFT JOIN m USING (row) LEFT JOIN g USING (row)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > lines) AS kept
FROM y
"""

ORACLES["op7_threshold_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256e0) AS BIGINT)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

ORACLES["op10_token_groups"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(r, m) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.m = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach USING (r) JOIN d other ON other.r = reach.m GROUP BY d.r, d.doc_id
"""

#: The unsigned crc32 of a list of bytes: its table follows from the polynomial.
_CRC = """
WITH RECURSIVE table256 AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [CAST(0 AS BIGINT) FOR _ IN range(8)]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)))"""


def _crc(value: str) -> str:
    """DuckDB expression over column t: unsigned crc32 of a text's UTF-8 bytes (code points below 2,048)."""
    points = f"list_transform(string_split({value}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    octets = f"flatten(list_transform({points}, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))"
    return (f"xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")


ORACLES["op11_word_runs"] = rf"""{_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, coalesce({_crc("CAST(doc_id AS VARCHAR)")}, 1) AS h
      FROM documents CROSS JOIN table256),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p, h % 10 = 0 AND n > 0 AS echo FROM e),
v AS (SELECT r, doc_id, n, CASE WHEN echo THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1])
                                ELSE w END AS w FROM f),
x AS (SELECT r, n, i - 1 AS i, w[i] AS word FROM (SELECT r, n, w, unnest(range(1, n + 1)) AS i FROM v)),
often AS (SELECT *, count(*) OVER (PARTITION BY r, word) AS times FROM x),
same AS (SELECT a.r, b.i - a.i AS q, a.i FROM often a JOIN x b ON b.r = a.r AND b.word = a.word AND b.i > a.i
         WHERE a.times >= 4 AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT r, q, min(i) AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k),
long AS (SELECT * FROM islands WHERE length >= greatest(6, 4 * q)),
found AS (SELECT * FROM long l WHERE NOT EXISTS (
            FROM long s WHERE s.r = l.r AND s.q < l.q AND s.start <= l.start AND s.start + s.length >= l.start + l.length)),
best AS (SELECT r, start, length, q FROM found
         QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) = 1),
lists AS (SELECT r, count(*) AS n, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS rows FROM found GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + q, start + length)) AS i FROM found),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT v.doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_runs, CAST(b.start AS BIGINT) AS start, CAST(b.length AS BIGINT) AS length,
       CAST(b.q AS BIGINT) AS period, CAST(1000 * b.length // b.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(l.rows, '')) AS runs_sha256, sha256(coalesce(o.text, '')) AS collapsed_sha256
FROM v LEFT JOIN lists l USING (r) LEFT JOIN best b USING (r) LEFT JOIN left_over o USING (r)
"""

ORACLES["op12_spelling_variants"] = rf"""{_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
marked AS (SELECT run, n, {_crc("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM counted CROSS JOIN table256),
altered AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, length(word) AS l, i, substr(word, 1, i) || substr(word, i + 2) AS rest
        FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
                  row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
                 CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
          FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chain AS (SELECT word, coalesce(form, word) AS root FROM forms
          UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms f JOIN roots USING (word)
"""
