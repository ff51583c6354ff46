"""Embedding whitening with a weighted multiplicity covariance.

Entries become whole numbers, so equal vectors are recognised exactly. Identical vectors are grouped first; each
distinct one enters the covariance with a weight, its number of rows (``counts``) or one (``one``), is whitened
once, and joined back to its rows.

*Covariance.* Counts and sums are whole numbers, so the mean is exact: a whole part c and a remainder. A task
centres its vectors (x - c, then the remainder over n), multiplies them by their weights and keeps one d x d sum
(a GEMM a batch); the rows of these sums are added up by row number, in the order of tasks. The driver gets d sums
and d x d entries, whatever the number of rows, and computes the eigenvectors.

*Scale.* Two shuffles of vectors: the grouping, which combines copies before it, and the join back. There a vector
that has over a thousandth of all rows (at most 1,000 of them, so they are broadcast) is dealt to several tasks.

Defined results: rows with a null vector, or with null or non-finite entries, are left out. Vectors of another
length than the commonest (ties: the shorter) can't be projected: each such row comes back once, its component and
figures null. A component without variance (eigenvalue at most d * 1e-13 of the trace) has whitened null and
explained 0 (null if the trace is 0); identity_error looks at the others, and is null if there are none. Entries beyond 2**52 in size count as that.
Null ids and repeated rows come back each. A deviation of more than 38 digits (63 bits in op13's long) is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: A vector with over one of so many rows is joined in several tasks.
HOT = 1_000
_FAR = float(1 << 52)
_LIMB = 26


def quantised(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of long): the rows whose vector is whole."""
    v = F.col(vec_col).cast("array<double>")
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    far = lambda c: F.greatest(F.least(c * SCALE, F.lit(_FAR)), F.lit(-_FAR))
    return df.where(v.isNotNull() & ~broken).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(far(c)) + SHIFT).alias("x"))


def grouped(rows: DataFrame) -> DataFrame:
    """x, copies, d: each distinct vector once."""
    return rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _weights(b: pa.RecordBatch, weights: str) -> np.ndarray:
    return b["copies"].to_numpy() if weights == "counts" else np.ones(b.num_rows, np.int64)


def sums(vectors: DataFrame, weights: str) -> tuple[int, list[int]]:
    """Total weight and exact weighted sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            if b.num_rows:
                w, x = _weights(b, weights), _matrix(b["x"])
                n += int(w.sum())
                high, low = high + w @ (x >> _LIMB), low + w @ (x & ((1 << _LIMB) - 1))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    parts = vectors.select("x", "copies").mapInArrow(run, "i int, n long, high long, low long")
    found = parts.groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low")).orderBy("i").collect()
    return (found[0][1] if found else 0), [(r[2] << _LIMB) + r[3] for r in found]


def gram(frame: DataFrame, centred: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], d: int) -> np.ndarray:
    """Sum of w * y * y' over all rows, where centred gives the rows y of a batch and their weights w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y, w = centred(b)
                total += (y * w[:, None]).T @ y
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, d * d + 1, d), pa.int32()), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), rows], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = -1, np.zeros(d)
        for b in batches:
            for i, row in zip(b["i"].to_pylist(), _matrix(b["row"]) if b.num_rows else ()):
                if i != now and now >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()])], names=["i", "row"])
                    total = np.zeros(d)
                now, total = i, total + row
        if now >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()])], names=["i", "row"])

    parts = frame.mapInArrow(run, "i int, row array<double>").withColumn("task", F.spark_partition_id())
    found = parts.repartition("i").sortWithinPartitions("i", "task").select("i", "row").mapInArrow(added, "i int, row array<double>").collect()
    out = np.zeros((d, d))
    for r in found:
        out[r[0]] = r[1]
    return out


class Model:
    """Mean c + rest / n, unit eigenvectors as columns, eigenvalues and the trace of the covariance."""

    def __init__(self, n: int, total: list[int], components: int) -> None:
        self.n, self.total, self.components = n, total, components
        self.whole = np.array([s // n for s in total], np.int64)
        self.rest = np.array([s % n / n for s in total])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def solve(self, covariance: np.ndarray) -> None:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values, kind="stable")[: self.components]
        self.trace, self.values, vectors = float(np.trace(covariance)), values[order], vectors[:, order]
        self.vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
        self.sound = self.values > len(covariance) * 1e-13 * self.trace

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """NaN where a component has no variance."""
        z = self.centred(x) @ self.vectors
        return np.where(self.sound, z / np.sqrt(np.where(self.sound, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - total)**2."""
        y = x - self.whole
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * max(x.shape[1], 1) < 1 << 62:
            return ((self.n * y - np.array([s % self.n for s in self.total], np.int64)) ** 2).sum(axis=1).tolist()
        rest = [s % self.n for s in self.total]
        exact = (sum((self.n * a - r) ** 2 for a, r in zip(row, rest, strict=True)) for row in y.tolist())
        return [v if v < 10**38 else None for v in exact]


def fit(vectors: DataFrame, weights: str = "one", components: int = COMPONENTS) -> Model | None:
    """vectors: x, copies, all of one length; None without vectors or dimensions."""
    n, total = sums(vectors, weights)
    if not total:
        return None
    model = Model(n, total, components)
    model.solve(gram(vectors.select("x", "copies"), lambda b: (model.centred(_matrix(b["x"])), _weights(b, weights)), len(total)) / n)
    return model


def _identity_error(applied: DataFrame, model: Model, weights: str) -> float | None:
    k = int(model.sound.sum())
    if not k:
        return None
    pick = np.flatnonzero(model.sound)
    part = F.when(F.lit(weights == "counts"), F.col("copies")).otherwise(F.lit(1))
    means = np.array(applied.agg(*(F.sum(part * F.element_at("z", int(i) + 1)) for i in pick)).first()) / model.n
    covariance = gram(applied.select("z", "copies"), lambda b: (_matrix(b["z"])[:, pick] - means, _weights(b, weights)), k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", weights: str = "one", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained, identity_error."""
    spark = df.sparkSession
    common.small_batches(spark)
    rows = quantised(df, id_col, vec_col)
    each = common.stored(grouped(rows), "vectors")
    lengths = each.groupBy("d").agg(F.sum("copies").alias("rows"))
    common_length = lengths.orderBy(F.desc("rows"), "d").first()
    d = common_length["d"] if common_length else 0
    same = each.where(F.col("d") == d)
    model = fit(same, weights, components)

    def apply(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(b["x"]) if b.num_rows else np.zeros((0, d), np.int64)
        z = model.whitened(x)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32()), pa.array(z.ravel()))
        far = pa.array([None if v is None else Decimal(v) for v in model.deviations(x)], pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([b["x"], b["copies"], far, lists], names=["x", "copies", "deviation", "z"])

    made = "x array<long>, copies long, deviation decimal(38,0), z array<double>"
    if model is None:
        applied, error, shares = spark.createDataFrame([], made), None, []
    else:
        applied = common.stored(common.mapped(same.select("x", "copies"), apply, made), "whitened")
        error, shares = _identity_error(applied, model, weights), [float(e) / model.trace if model.trace > 0 else None for e in np.where(model.sound, model.values, 0.0)]

    total = each.agg(F.sum("copies")).first()[0] or 0
    hot = each.where(F.col("copies") * HOT > total).select("x", F.ceil(F.col("copies") * HOT / max(total, 1)).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(hot), "x", "left").withColumn("part", F.pmod(F.xxhash64("vec_id", F.spark_partition_id()), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    held = applied.join(F.broadcast(hot), "x", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select("x", "part", "deviation", "z")
    joined = dealt.join(held, ["x", "part"], "left").select("vec_id", "deviation", F.posexplode_outer("z").alias("at", "value"))
    number = F.lit(model.n if model else None).cast("long")
    real: Callable[[float | None], Column] = lambda v: F.lit(v).cast("double")
    return joined.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.when(F.col("at").isNotNull(), number).alias("n"),
        "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"),
        F.when(F.col("at").isNotNull(), F.element_at(F.array(*map(real, shares)), F.col("at") + 1) if shares else real(None)).alias("explained"),
        real(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(common.read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
