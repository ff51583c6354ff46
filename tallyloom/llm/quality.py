"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled good; the unlabelled set is any text of the corpus (rows labelled
bad are never used as such). The share of good texts among the unlabelled, the class prior, is
estimated by the best-bin rule: a first classifier separates positives from unlabelled texts; then
the smallest ratio, over score cuts, of the unlabelled share above the cut to the positive share above
it, is the prior (on halves that were not fitted, with a confidence margin). The final linear model
minimises ``prior * E+[l(f)] + max(0, E_u[l(-f)] - prior * E+[l(-f)])`` with the logistic loss; when the
bracket falls below 0 in a mini-batch, the step goes against its gradient, as the estimator asks.

Features describe form, not vocabulary: binned statistics (shares of letters, capitals, digits, rare
symbols, blanks; word lengths; share of distinct words; repeats of words, lines and 4-word windows)
and hashed word shapes and pairs of them (first two and last three characters, letters as ``a``/``A``,
digits as ``0``, others kept). All are computed where the texts lie; about ``max_rows`` positives and as many
unlabelled rows, chosen by a hash of the id, go as coordinates to the one task that fits: ``max_rows`` bounds
the sample on which the risk is estimated, whatever the corpus's size. Scoring
covers every row and the whole text; no text is shuffled.

Defined results: null and empty texts have the features of zero words and get the score learned for
them. No trusted positive: every score is the prior 0.5. Repeated rows count as often as they come.
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

#: Coordinates of hashed shape pairs, besides the bins.
SHAPES = 1 << 10
BINS = 16
MAX_ROWS = 4_000
CACHE_WORDS = 300_000
STEPS, BATCH, RATE, DECAY = 1500, 256, 0.02, 1e-5

_CLASSES = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 .,;:'"!?- 6 not ASCII
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 1, 2, 3, 6
_CLASSES[[9, 10, 11, 12, 13, 32]] = 4
_CLASSES[list(b".,;:'\"!?-")] = 5
#: Letters to a or A, digits to 0, bytes outside ASCII to a, the rest kept.
_LETTERS = bytes(ord("a") if c in (1, 6) else ord("A") if c == 2 else ord("0") if c == 3 else i for i, c in enumerate(_CLASSES))
STATS = 16


def shape(word: bytes) -> bytes:
    """The first two and last three characters, by kind."""
    kinds = word.translate(_LETTERS)
    return kinds[:2] + kinds[-3:]


class _Shapes(dict):
    """word -> (number of the word while remembered << 32) | hash of its shape."""

    def __missing__(self, word: bytes) -> int:
        self[word] = v = (len(self) << 32) | xxhash.xxh32_intdigest(shape(word))
        return v


_SHAPES = _Shapes()


def _forget() -> None:
    _SHAPES.clear()


def statistics(text: bytes, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """STATS numbers from 0 to 1."""
    n, size = len(words), len(text)
    if not n:
        return np.zeros(STATS)
    per = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=7)
    letters = per[1] + per[2] + per[6]
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = np.unique(ids, return_counts=True)[1]
    lengths = np.fromiter(map(len, words), np.int64, n)
    quads = ids[: n - 3] * 31 + ids[1 : n - 2] * 1009 + ids[2 : n - 1] * 100_003 + ids[3:] * 10_000_019 if n > 3 else ids
    return np.array([
        0.05 + min(np.log2(n) / 20, 0.95), letters / size, per[2] / max(letters, 1), per[3] / size * 4, per[0] / size * 4, per[4] / size * 2, per[5] / size * 4,
        lengths.mean() / 20, lengths.std() / 10, lengths.max() / 60, len(distinct) / n, distinct.max() / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines), 1 - len(np.unique(quads)) / len(quads), n / max(len(lines), 1) / 200,
    ])


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values: each statistic's bins up to the one it falls in (value 1), shapes and
    shape pairs (log frequency, together of length 2), and coordinate 0, which is always 1."""
    if len(_SHAPES) > CACHE_WORDS:
        _SHAPES.clear()
    words = common.words_of(text)
    both = np.fromiter(map(_SHAPES.__getitem__, words), np.int64, len(words))
    shapes = both & 0xFFFFFFFF
    bins = np.minimum((np.sqrt(np.clip(statistics(text, words, both >> 32), 0, 1)) * BINS).astype(np.int64), BINS - 1)
    at = 1 + np.flatnonzero(np.arange(BINS)[None, :] <= bins[:, None])
    pairs = np.concatenate((shapes, (shapes[:-1] * 0x9E3779B1 + shapes[1:] * 0x85EBCA77) & 0x7FFFFFFF)) if len(words) else shapes
    got, count = np.unique(pairs * 0x2C1B3C6D % 0x7FFFFFFF % SHAPES, return_counts=True)
    value = np.log1p(count)
    value /= max(np.sqrt((value**2).sum()), 1e-9)
    return np.concatenate(([0], at, 1 + STATS * BINS + got)).astype(np.int32), np.concatenate((np.ones(1 + len(at)), 2 * value)).astype(np.float32)


WIDTH = 1 + STATS * BINS + SHAPES


def _dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, (at, v) in enumerate(rows):
        x[i, at] = v
    return x


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Adam on the non-negative risk; with prior None, on plain positive-versus-unlabelled loss."""
    rng, w = np.random.default_rng(seed), np.zeros(positive.shape[1], np.float32)
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p, u = positive[rng.integers(0, len(positive), BATCH)], unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        fp, fu = p @ w, u @ w
        up = p.T @ (_sigmoid(fp) - 1) / BATCH  # gradient of E+[l(f)]
        down = p.T @ _sigmoid(fp) / BATCH  # of E+[l(-f)]
        away = u.T @ _sigmoid(fu) / BATCH  # of Eu[l(-f)]
        if prior is None:
            g = up + away
        elif np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean() >= 0:
            g = prior * up + away - prior * down
        else:
            g = prior * down - away
        g = g + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            mean += w / (steps - steps // 2)
    return mean


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate: fitted on even rows, read off odd rows."""
    w = minimise(positive[::2], unlabelled[::2], None, STEPS // 3)
    p, u = np.sort(positive[1::2] @ w), np.sort(unlabelled[1::2] @ w)
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Weights of the model, and the class prior. An empty array: nothing to learn from."""
    spark = docs.sparkSession
    good = labels.where((F.col(label) == 1) & F.col(id_col).isNotNull())
    good = good.where(learn) if learn is not None else good
    good = _few(good.select(F.col(id_col).alias("doc_id")).distinct(), max_rows).withColumn("good", F.lit(True))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = slim.where("doc_id IS NOT NULL")
    # an id drawn for both sets serves in both
    drawn = common.below(max_rows / max(base.select("doc_id").count(), 1))
    rows = base.join(F.broadcast(good), "doc_id", "left").withColumn("drawn", F.xxhash64("doc_id", F.lit(1)) <= drawn).where("good OR drawn")

    def sparse(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [features(t) for t in common.texts(b["text"])]
        return pa.RecordBatch.from_arrays(
            [b["doc_id"].cast(pa.int64()), b["good"].fill_null(False), b["drawn"], pa.array([x for x, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32()))],
            names=["doc_id", "good", "drawn", "at", "value"],
        )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: tuple[list, list] = ([], [])
        for b in batches:
            for g, d, at, v in zip(b["good"].to_pylist(), b["drawn"].to_pylist(), b["at"], b["value"], strict=True):
                row = (at.values.to_numpy(), v.values.to_numpy())
                if g:
                    sets[0].append(row)
                if d:
                    sets[1].append(row)
        if sets[0] and sets[1]:
            p, u = map(_dense, sets)
            pi = prior if prior is not None else estimate_prior(p, u)
            yield pa.RecordBatch.from_arrays([pa.array([minimise(p, u, pi).astype(float)], pa.list_(pa.float64())), pa.array([pi])], names=["w", "prior"])

    made = common.mapped(rows, sparse, "doc_id long, good boolean, drawn boolean, at array<int>, value array<float>")
    # One task: at most about 2 * max_rows rows of a few hundred coordinates.
    got = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(train, "w array<double>, prior double").collect()
    return (np.array(got[0]["w"]), got[0]["prior"]) if got else (np.empty(0), 0.5)


def _few(ids: DataFrame, most: int) -> DataFrame:
    return ids.where(F.xxhash64("doc_id") <= common.below(most / max(ids.count(), 1)))


def scorer(spark: SparkSession, w: np.ndarray):
    """Column function text -> score, with the model broadcast (WIDTH numbers)."""
    sent = spark.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for texts in batches:
            out = []
            for t in texts:
                at, v = features((t or "").encode("utf-8", "replace"))
                out.append(float(w[at] @ v) if len(w) else 0.0)
            yield pd.Series(_sigmoid(np.array(out, float)))
        _forget()

    return score


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: crc32(doc_id) mod 5 = 0. One row per document."""
    common.small_batches(spark)
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    held = common.fold(F.col("doc_id"), 5) == 0
    w, _ = fit(docs, labels, "quality", ~held)
    out = docs.select("doc_id", held.alias("held_out"), scorer(spark, w)("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
