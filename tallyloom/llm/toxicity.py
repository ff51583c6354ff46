"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the *presence* of its words, of pairs of adjacent words, of pairs with one
word skipped between them, and of the words' stems of 4 and 5 letters (inflected and compound
forms); words are lower-cased (A-Z) with punctuation cut from their ends. A feature's 64-bit hash is
reduced to ``2 ** bits`` coordinates. Training is per coordinate: each keeps a sum of gradients ``z``
and of squared gradients ``n``, from which the weight follows in closed form; coordinates whose
``|z|`` stays within ``l1`` have weight 0, so the model is a short list.

Features of the labelled rows are made where the texts lie; at most ``max_rows`` of these rows,
chosen by a hash of the id, go as coordinates to the one task that learns (the learner is
sequential). The model, at most ``2 ** bits`` weights and in practice a thousand or so, is broadcast to
score every text where it lies: no shuffle of texts. Scoring covers all rows and all words.

*Long texts.* A weight counts only for the one feature it was learned from: beside each weight stands the
whole 64-bit hash of the labelled rows' feature of that coordinate that tells the labels apart best in
the weight's direction, and other features of the coordinate count nothing. So a text's score is not raised
by the mere number of its words. A text is scored in windows of ``WINDOW`` words; of n windows the highest counts, less
``LENGTH * log(n)``. The scores of clean labelled rows have an exponential tail of scale ``LENGTH`` (mean excess over
their highest tenth: 0.45 to 0.51 on sf0.1), so the highest of n clean windows grows by as much, and a longer text has
no more chances to be taken for toxic, while a toxic window loses 2.6 among 200.

Defined results: null and empty texts score the intercept. No labelled row: every score is 0.
Repeated rows count as often as they come. Rows with a null label or id are not learned from.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
EPOCHS = 3
#: Letters of the stems that count as words of their own, for inflected forms.
STEMS = (4, 5)
#: Labelled rows used to fit, at most.
MAX_ROWS = 12_000
#: Words that are scored together.
WINDOW, LENGTH = 2_000, 0.5
#: Distinct words whose hashes a Python worker remembers.
CACHE_WORDS = 300_000
EDGE = b".,;:!?\"'()[]{}<>"


class Vocabulary(dict):
    """word -> row of ``hashes``: 64-bit hashes of the cleaned word and of its two stems. Remembers up
    to a bound and starts anew between texts, never within one."""

    def __init__(self) -> None:
        self.hashes = np.empty((3, 1 << 16), np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == self.hashes.shape[1]:
            self.hashes = np.concatenate((self.hashes, np.empty_like(self.hashes)), axis=1)
        clean = word.strip(EDGE).lower()
        letters = clean.decode("utf-8", "replace")
        self.hashes[:, i] = [xxhash.xxh3_64_intdigest(clean), *(xxhash.xxh3_64_intdigest(letters[:n], n) if len(letters) > n else 0 for n in STEMS)]
        self[word] = i
        return i

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.hashes[:, at]


_VOCABULARY = Vocabulary()
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _forget() -> None:
    _VOCABULARY.clear()


def hashes(text: bytes) -> list[np.ndarray]:
    """64-bit hashes by kind: words, pairs, skips and stems (0 where a word has none). A hash's place is that
    of its first word. bytes.lower() lowers A-Z only."""
    words = common.words_of(text)
    if not words:
        return []
    h, *stems = _VOCABULARY.rows(words)
    m = h * _MIX
    pairs = (m[:-1] ^ (h[1:] >> np.uint64(7))) * _MIX
    skips = (m[:-2] ^ (h[2:] >> np.uint64(13)) ^ np.uint64(1)) * _MIX
    return [m, pairs, skips, *stems]


def occurrences(text: bytes, bits: int = BITS) -> np.ndarray:
    """A text's coordinates, one for each occurrence."""
    found = hashes(text)
    if not found:
        return np.empty(0, np.int64)
    return (np.concatenate((*found[:3], *(x[x > 0] for x in found[3:]))) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Sorted distinct coordinates of a text."""
    return np.unique(occurrences(text, bits)).astype(np.int32)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of 2 ** bits coordinates and, last, the intercept (not penalised by l1)."""
    size = 2**bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0.0

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1[at], 0.0, -(zz - np.sign(zz) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for i in order:
            at = np.append(rows[i], size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates and weights that are not 0, and the hash of the feature each weight is for (0 for the
    intercept)."""
    picked = common.stored(labelled_sample(docs, labels, label, learn, id_col, text_col, max_rows), "labelled")
    coordinates = common.mapped(
        picked,
        lambda b: pa.RecordBatch.from_arrays([b["_h"], b["y"], pa.array([features(t, bits) for t in common.texts(b["text"])], pa.list_(pa.int32()))], names=["_h", "y", "at"]),
        "_h long, y double, at array<int>",
        _forget,
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            rows += [x.values.to_numpy() for x in b["at"]]
            y += b["y"].to_pylist()
        if rows:
            w = fit_rows(rows, np.array(y), bits)
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at]), pa.array(np.full(len(at), np.mean(y)))], names=["at", "w", "mean"])

    # One task: the learner is sequential and its rows are bounded by max_rows and 2 ** bits.
    model = coordinates.repartition(1).sortWithinPartitions("_h", "at").mapInArrow(train, "at long, w double, mean double").toPandas()
    at, w = model["at"].to_numpy(np.int64), model["w"].to_numpy(float)
    return at, w, _marks(picked, at, w, float(model["mean"].max()) if len(at) else 0.0, bits)


def _marks(picked: DataFrame, at: np.ndarray, w: np.ndarray, mean: float, bits: int) -> np.ndarray:
    """For each weight, the hash of its coordinate with the largest sum of (label - mean) times the weight's sign
    over the labelled rows that have it."""
    signs = np.zeros(2**bits + 1)
    signs[at] = np.sign(w)
    signs[2**bits] = 0.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, sums = [np.empty(0, np.uint64)], [np.empty(0)]
            for t, y in zip(common.texts(b["text"]), b["y"].to_pylist(), strict=True):
                if parts := hashes(t):
                    h = np.concatenate(parts)
                    h = np.unique(h[(h > 0) & (signs[h >> np.uint64(64 - bits)] != 0)])
                    found.append(h)
                    sums.append(np.full(len(h), y))
            h, y = np.concatenate(found), np.concatenate(sums)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((h >> np.uint64(64 - bits)).astype(np.int64)), pa.array(y)], names=["h", "at", "y"])
        _forget()

    each = picked.mapInArrow(count, "h long, at long, y double").groupBy("at", "h").agg(F.sum("y").alias("y"), F.count("y").alias("n"))
    each = each.select("at", "h", (F.col("y") - mean * F.col("n")).alias("s"))
    best = each.groupBy("at").agg(F.max_by("h", F.struct("s", "h")).alias("high"), F.min_by("h", F.struct("s", "h")).alias("low"))
    marks = np.zeros(2**bits + 1, np.int64)
    for r in best.collect() if len(at) else []:  # at most a row for each weight
        marks[r["at"]] = r["high"] if signs[r["at"]] > 0 else r["low"]
    return marks[at].view(np.uint64)


def labelled_sample(docs, labels, label, learn, id_col, text_col, max_rows) -> DataFrame:
    """Labelled rows with their texts: all of them, or those with the smallest hashes of their ids if
    there are more than max_rows."""
    l = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        l = l.where(learn)
    l = l.select(F.col(id_col).alias("doc_id"), F.col(label).cast("double").alias("y"), F.xxhash64(F.col(id_col)).alias("_h"))
    total = l.count()
    if total > max_rows:
        l = l.where(F.col("_h") <= common.below(max_rows / total))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(l), "doc_id")  # l: at most about max_rows


def raw_score(text: bytes, dense: np.ndarray, marks: np.ndarray, bits: int = BITS, window: int = WINDOW) -> float:
    """Sum of the weights of a text's features, without the intercept, in its highest window, less what its number of windows accounts for."""
    found, n = [], 1
    for part in hashes(text):
        n = max(n, len(part))
        at = (part >> np.uint64(64 - bits)).astype(np.int64)
        k = np.flatnonzero(dense[at])
        k = k[marks[at[k]] == part[k]]
        found.append((k // window << bits) + at[k])
    if not found:
        return 0.0
    codes = np.unique(np.concatenate(found))
    windows = -(-n // window)
    sums = np.bincount(codes >> bits, dense[codes & (1 << bits) - 1], windows)
    return float(sums.max() - LENGTH * np.log(windows))


def scorer(spark: SparkSession, model: tuple[np.ndarray, np.ndarray, np.ndarray], bits: int = BITS):
    """Column function text -> probability, with the model broadcast."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, w, which = sent.value
        dense, marks = np.zeros(2**bits + 1), np.zeros(2**bits + 1, np.uint64)
        dense[known], marks[known] = w, which
        base = dense[2**bits]
        for texts in batches:
            raw = [base + raw_score((t or "").encode("utf-8", "replace"), dense, marks, bits) for t in texts]
            out = 1.0 / (1.0 + np.exp(-np.clip(np.array(raw, float), -35, 35)))
            yield pd.Series(out if len(known) else out * 0.0)
        _forget()

    return score


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: crc32(doc_id) mod 4 = 2. One row per document."""
    common.small_batches(spark)
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held = common.fold(F.col("doc_id"), 4) == 2
    score = scorer(spark, fit(docs, labels, "toxic", ~held))
    out = docs.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
