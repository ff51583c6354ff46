"""What the training-data operators share: reading, shared storage, words, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of bytes other than ASCII white space, in Java's and RE2's syntax.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of one Arrow batch sent to Python, about; a single row may be longer.
BATCH_BYTES = 4 << 20
#: Rows of one batch that Python returns, where rows may be long.
BATCH_ROWS = 256
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes sent to Python at a time, as one row may be megabytes. All operators want the same bound,
    so that it doesn't matter when a lazy frame runs; a smaller one that is set already stays."""
    now = spark.conf.get(_BYTES_SETTING, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(_BYTES_SETTING, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir, or where that
    is unset, in a local session only, a fresh temporary one."""
    sc: SparkContext = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back (for what is too large for checkpoint's
    uncompressed rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() splits on exactly the ASCII white space 0x20, 0x09-0x0D."""
    return text.split()


def n_words(text: Column) -> Column:
    """Number of words, JVM-side; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def below(share: float) -> int:
    """64-bit hashes up to this are a share of all hashes, however small."""
    return min(-(1 << 63) + int(max(share, 0.0) * (1 << 64)), (1 << 63) - 1)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, done: Callable[[], None] | None = None) -> DataFrame:
    """One Arrow batch in, one out. done: called when a partition is through, to let go of what a reused
    worker would otherwise hold on to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)
        if done:
            done()

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def bounded(df: DataFrame, most: int) -> bool:
    """True if df has at most that many rows, found by a count that stops there."""
    return df.limit(most + 1).count() <= most


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, most: int = 1_000_000) -> DataFrame:
    """Join that broadcasts the small side only after its row count was checked; beyond the bound
    both sides are shuffled and adaptive execution splits hot keys."""
    if bounded(small, most):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)
