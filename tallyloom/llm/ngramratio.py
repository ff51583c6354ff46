"""Quality rules, DataFrame functions only: log-likelihood ratio of hashed n-grams, target against raw corpus.

Words and pairs of adjacent words are hashed to buckets (words by their CRC-32, pairs by a product of their
words' buckets). Two multinomials are counted, over all texts: one of trusted
target documents, one of the raw corpus. A document's score is the sum over its n-grams of
``ln(target share / raw share)``, each share smoothed by one count, divided by the number of
n-grams; weights are rounded to millionths, so sums are exact whole numbers and don't depend on the order
of adding. Every document gets a verdict by the same threshold.

Counting explodes words beside their next ones, hashes them in generated code and aggregates map-side first: at
most ``2 * BUCKETS`` groups, whose weights return as one literal array that the scoring expression indexes.
Scoring and base counts are array functions of one row and move no text. The target's ids are broadcast
after a check of their number; beyond it the target's texts, and no others, go through a shuffle.

Base counts: see ``counts``. Repeated windows are found by sorting the hashes of a text's 8-word windows (of
words, then of neighbours two, four and eight wide) and measured by the union of their places.

Defined results: null text has no words and fails the base rule. No target documents: all weights are
0 and only the base rule decides. Texts of one word have one n-gram. Repeated rows count as often as
they come. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
UNIT = 1_000_000
#: A document's mean log-likelihood ratio below which it goes, in millionths.
THRESHOLD = -100_000
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: Target documents whose ids are broadcast, at most.
TARGET_IDS = 2_000_000
SYMBOLS = "[#*$%&|<>]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), common.SPACE), "")


def bucket(word: Column) -> Column:
    return F.crc32(word.cast("binary")).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def pair_bucket(x: Column, y: Column) -> Column:
    """Of two neighbours' buckets; numbered after those of words."""
    return (x * 31 + y * 17 + 7).bitwiseAND(F.lit(BUCKETS - 1)) + BUCKETS


def _after(values: Column, n: int) -> Column:
    return F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))


def windows(words: Column) -> Column:
    """Hashes of all WINDOW words in a row; at least that many words."""

    def wider(n: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - n), _after(h, n), lambda x, y: F.xxhash64(x, y))

    out = F.transform(words, lambda w: F.xxhash64(w))
    for n in (1, 2, 4):
        out = bind(out, wider(n))
    return out


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that come twice or more in the text."""

    def places(sorted_windows: Column) -> Column:
        same = lambda x, i: F.get(sorted_windows, i)["h"] == x["h"]
        twice = F.filter(sorted_windows, lambda x, i: F.coalesce(same(x, i + 1), F.lit(False)) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
        return F.array_sort(F.transform(twice, lambda x: x["at"]))

    def union(at: Column) -> Column:
        # each window adds the words up to the next one's start
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def with_hashes(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(bind(placed, places), union)).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(words) > WINDOW, bind(windows(words), with_hashes)).otherwise(F.lit(0).cast("long"))


def counts(text: Column, words: Column) -> list[Column]:
    """n_words; word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines
    with a word, equal to an earlier line; n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return [
        F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
    ]


def weights(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TARGET_IDS) -> list[int]:
    """Of each bucket, in millionths: words first, then pairs. most: target ids that are broadcast, at most."""
    ids = target_ids.select(F.col(id_col).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_target", F.lit(1))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if common.bounded(ids, most):
        rows = slim.join(F.broadcast(ids), "_id", "left").select("_text", F.lit(1).alias("_raw"), F.coalesce("_target", F.lit(0)).alias("_target"))
    else:
        good = slim.join(ids.hint("merge"), "_id", "left_semi").select("_text", F.lit(0), F.lit(1))
        rows = slim.select("_text", F.lit(1).alias("_raw"), F.lit(0).alias("_target")).union(good)
    words = words_of(F.col("_text"))
    pairs = rows.select("_raw", "_target", F.explode(F.transform(F.array(words), lambda w: F.arrays_zip(w.alias("x"), _after(w, 1).alias("y")))).alias("_w"))
    pairs = pairs.select("_raw", "_target", F.inline("_w").alias("x", "y")).select("_raw", "_target", bucket(F.col("x")).alias("x"), bucket(F.col("y")).alias("y"))
    each = pairs.select("_raw", "_target", F.explode(F.array("x", pair_bucket(F.col("x"), F.col("y")))).alias("bucket")).where("bucket IS NOT NULL")
    seen = each.groupBy("bucket").agg(F.sum("_raw").alias("raw"), F.sum("_target").alias("target")).collect()  # at most 2 * BUCKETS rows
    raw, target = [0] * 2 * BUCKETS, [0] * 2 * BUCKETS
    for r in seen:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    out: list[int] = []
    for low in (0, BUCKETS):
        t, n = sum(target[low : low + BUCKETS]), sum(raw[low : low + BUCKETS])
        out += [round(UNIT * math.log((target[i] + 1) / (t + BUCKETS) * ((n + BUCKETS) / (raw[i] + 1)))) if t else 0 for i in range(low, low + BUCKETS)]
    return out


def judge(docs: DataFrame, model: list[int], threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, n_ngrams, llr (sum, in millionths), kept."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")  # folded to one literal

    def row(text: Column, words: Column) -> Column:
        worth = lambda x, y: F.get(table, x) + F.coalesce(F.get(table, pair_bucket(x, y)), F.lit(0))
        each = bind(F.transform(words, bucket), lambda b: F.zip_with(b, _after(b, 1), worth))
        total = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(*counts(text, words), F.greatest(2 * F.size(words) - 1, F.lit(0)).cast("long").alias("n_ngrams"), total.alias("llr"))

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    # one generated row a document: its fields are computed once, however often they are used below
    found = slim.select("doc_id", F.inline_outer(F.transform(F.array(words_of(F.col("_text"))), lambda w: row(F.col("_text"), w))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("llr") >= threshold * F.col("n_ngrams")))


def op4_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of good quality; raw: all documents."""
    docs = common.read(spark, sf_dir, "documents")
    return judge(docs, weights(docs, common.read(spark, sf_dir, "labels").where("quality = 1")))


OP4_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good
  FROM documents
), u AS (
  SELECT k, good, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), c AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), v AS (
  SELECT word, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]))) & {BUCKETS - 1} AS x
  FROM (SELECT DISTINCT word FROM u), c
), b AS (
  SELECT k, good, i, x FROM u JOIN v USING (word)
), n AS (
  SELECT k, good, x AS bucket FROM b
  UNION ALL
  SELECT k, good, ((x * 31 + y * 17 + 7) & {BUCKETS - 1}) + {BUCKETS} FROM (SELECT *, lead(x) OVER (PARTITION BY k ORDER BY i) AS y FROM b) WHERE y IS NOT NULL
), m AS (
  SELECT bucket, bucket >= {BUCKETS} AS pair, count(*) AS raw, count(*) FILTER (good) AS target FROM n GROUP BY 1, 2
), s AS (
  SELECT bucket, CASE WHEN sum(target) OVER (PARTITION BY pair) = 0 THEN 0 ELSE
    CAST(round({UNIT} * ln((target + 1)::DOUBLE / (sum(target) OVER (PARTITION BY pair) + {BUCKETS}) * ((sum(raw) OVER (PARTITION BY pair) + {BUCKETS})::DOUBLE / (raw + 1)))) AS BIGINT) END AS weight
  FROM m
), l AS (SELECT k, CAST(sum(weight) AS BIGINT) AS llr FROM n JOIN s USING (bucket) GROUP BY k),
win AS (SELECT k, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i, w FROM d WHERE len(w) > {WINDOW}),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS times FROM win),
r AS (
  SELECT k, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM h WHERE times > 1) GROUP BY k
), lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), a AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    greatest(2 * len(w) - 1, 0)::BIGINT AS n_ngrams, coalesce(llr, 0)::BIGINT AS llr
  FROM d LEFT JOIN l USING (k) LEFT JOIN r USING (k) LEFT JOIN lines USING (k)
), f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND llr >= {THRESHOLD} * n_ngrams AS kept FROM f
"""
