"""Token-ID files: static range asymmetric numeral system with shared frequency tables.

``write`` turns texts into ids with the tokenizers library, appends an end id to each document and
codes them, in ascending id order, into segment files. One frequency table, counted over all ids of the
corpus and scaled to ``2 ** PRECISION`` (more for very large vocabularies), serves every segment. Ids are coded in blocks; a block is a set
of interleaved coder states (lanes) that share one word stream, so a step codes one id in each lane
by whole-array arithmetic. A segment's index holds each block's checkpoint (first id, byte offset, lanes)
and CRC-32 of its ids, so any block is decoded and verified on its own, in parallel with others.

Segment: magic, header (``struct`` HEADER: version, documents, ids, blocks, CRC-32 of the frequency
table), document ids (int64) and counts (uint32) deflated, the block index (BLOCK each), then blocks:
lane states (uint64) and the word stream (uint32).

Work on Spark: pass 1 tokenizes each input partition where it lies and writes ids to the shared
folder; pass 2 counts ids by a grouped aggregation (at most one row per vocabulary entry reaches the
driver, and is broadcast back as the table); pass 3 deals documents into ranges of doc_id, sorts each
and codes it as a stream, at most a segment in memory. ``read`` decodes segments in any order. Starts
come from segment counts alone: running sums within a range, and over ranges.

The distinct words of a batch are few, so each is encoded by the library once and remembered (see
``presplit``). Ids take 16 bits on the way if the vocabulary allows it, else 32. Defined results: null and
empty texts have just the end id. Repeated doc_ids are all kept, in order of a hash of their ids, and may
share out over ranges. A null doc_id sorts first. A damaged block fails its checksum and raises. An end id
outside the vocabulary raises. An empty table gives no segment. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, presplit
from .bpe import Sent, byte_letters, default_path

PRECISION = 18
LOW = np.uint64(1 << 31)
LANES = 4096
#: Ids of a block, and of a segment (a longer document makes a longer segment).
BLOCK_IDS, SEGMENT_IDS = 1 << 20, 1 << 22
MAGIC = b"RANSEG1\0"
HEADER = struct.Struct("<IIQII")
BLOCK = struct.Struct("<QQIII")
_NO_ID = -(1 << 63)


# ---- the coder


def precision_of(n: int) -> int:
    """Bits of the frequencies of n ids: every id must be able to keep 1."""
    return max(PRECISION, n.bit_length() + 1)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2 ** precision; every counted id keeps at least 1."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << precision_of(len(counts))
    if not total:
        return np.zeros(len(counts), np.int64)
    f = np.where(counts > 0, np.maximum(1, np.floor(counts / total * size).astype(np.int64)), 0)
    order = np.lexsort((np.arange(len(counts)), -counts))
    spare, i = size - int(f.sum()), 0
    while spare > 0:  # rounded down: the frequent ones take the rest
        f[order[0]] += spare
        spare = 0
    while spare < 0:  # many ids raised to 1: the frequent ones give
        give = min(-spare, int(f[order[i]]) // 2)
        f[order[i]] -= give
        spare, i = spare + give, i + 1
    return f


class Table:
    """Shared by all blocks: frequencies, their running sums, and the id at each slot."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.precision = precision_of(len(frequencies))
        self.f = np.asarray(frequencies, np.uint64)
        self.c = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(self.f), dtype=np.uint32), self.f.astype(np.int64))
        self.crc = zlib.crc32(np.asarray(frequencies, "<u4").tobytes())


def lanes_for(n: int) -> int:
    return max(1, min(LANES, n // 256))


def code_block(ids: np.ndarray, table: Table) -> tuple[int, bytes]:
    """Lanes, and the block's bytes: final states, then words in reading order."""
    lanes, k = lanes_for(len(ids)), np.uint64(table.precision)
    room, word = np.uint64(63 - table.precision), np.uint64(32)
    x = np.full(lanes, LOW, np.uint64)
    words, every_f, every_c = [], table.f[ids], table.c[ids]
    for start in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
        f, c = every_f[start : start + lanes], every_c[start : start + lanes]
        now = x[: len(f)]
        full = now >= f << room
        words.append(now[full].astype(np.uint32))
        now = np.where(full, now >> word, now)
        high = now // f
        x[: len(f)] = (high << k) + (now - high * f) + c
    return lanes, x.astype("<u8").tobytes() + np.concatenate(words[::-1]).astype("<u4").tobytes()


def decode_block(raw: bytes, n: int, lanes: int, table: Table) -> np.ndarray:
    x = np.frombuffer(raw, "<u8", lanes).copy()
    words, at = np.frombuffer(raw, "<u4", offset=8 * lanes), 0
    mask, k, word = np.uint64((1 << table.precision) - 1), np.uint64(table.precision), np.uint64(32)
    out = np.empty(n, np.uint32)
    for start in range(0, n, lanes):
        now = x[: min(lanes, n - start)]
        slot = now & mask
        s = table.slots[slot]
        out[start : start + lanes] = s
        now = table.f[s] * (now >> k) + slot - table.c[s]
        need = now < LOW
        used = int(need.sum())
        now[need] = now[need] << word | words[at : at + used]
        at += used
        x[: len(now)] = now
    if at != len(words) or (x != LOW).any():
        raise ValueError("a block doesn't end where its coder began")
    return out


def segment_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, table: Table) -> bytes:
    index, body, offset = [], [], 0
    for first in range(0, len(ids), BLOCK_IDS):
        part = ids[first : first + BLOCK_IDS]
        lanes, raw = code_block(part, table)
        index.append(BLOCK.pack(first, offset, len(part), lanes, zlib.crc32(part.astype("<u4").tobytes())))
        body.append(raw)
        offset += len(raw)
    names = zlib.compress(np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(), 1)
    sizes = zlib.compress(np.array(counts, "<u4").tobytes(), 1)
    head = MAGIC + HEADER.pack(1, len(doc_ids), len(ids), len(index), table.crc) + struct.pack("<II", len(names), len(sizes))
    return b"".join([head, names, sizes, *index, *body])


def read_segment(raw: bytes, table: Table, blocks: range | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, counts and the ids (of some blocks, if given)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a segment")
    at = 8 + HEADER.size
    _, docs, total, n, crc = HEADER.unpack_from(raw, 8)
    if crc != table.crc:
        raise ValueError("the segment was coded with another frequency table")
    a, b = struct.unpack_from("<II", raw, at)
    at += 8
    names = np.frombuffer(zlib.decompress(raw[at : at + a]), "<i8")
    counts = np.frombuffer(zlib.decompress(raw[at + a : at + a + b]), "<u4")
    index = [BLOCK.unpack_from(raw, at + a + b + i * BLOCK.size) for i in range(n)]
    body = at + a + b + n * BLOCK.size
    out = [np.empty(0, np.uint32)]
    for i in blocks if blocks is not None else range(n):
        first, offset, size, lanes, crc = index[i]
        end = index[i + 1][1] if i + 1 < n else len(raw) - body
        got = decode_block(raw[body + offset : body + end], size, lanes, table)
        if zlib.crc32(got.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
        out.append(got)
    return [None if d == _NO_ID else d for d in names.tolist()], counts, np.concatenate(out)


# ---- tokens by the library


_LETTERS = {b: c for c, b in byte_letters().items()}
#: A longer word is not remembered.
LONGEST = 64
#: Words that each of the two generations of a worker's memory holds.
REMEMBERED = 200_000


class Library(dict):
    """The tokenizers library: word -> ids (4 bytes each). Words are split as by the library's pre-tokenizer, and
    each distinct one goes through its model once; it is remembered in two generations: when the young one is
    full it becomes the old one, and words still in use move over as they are met."""

    def __init__(self, content: str) -> None:
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(content)
        self.model, self.old = self.t.model.tokenize, {}
        self.special = {x.content.encode(): struct.pack("<I", i) for i, x in self.t.get_added_tokens_decoder().items()}

    @property
    def size(self) -> int:
        return max(self.t.get_vocab(with_added_tokens=True).values(), default=-1) + 1

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word) or self.special.get(word)
        if got is None:
            ids = [t.id for t in self.model(word.decode("latin-1").translate(_LETTERS))]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        words = presplit.Words(column, tuple(x.decode() for x in self.special))
        known = list(map(self.__getitem__, words.distinct.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        return presplit.spread(np.frombuffer(b"".join(known), "<u4"), sizes, words)


_LIBRARIES: dict[str, Library] = {}


def _library(sent: Sent) -> Library:
    if sent.id not in _LIBRARIES:
        _LIBRARIES.clear()
        _LIBRARIES[sent.id] = Library(sent.value)
    return _LIBRARIES[sent.id]


def _forget() -> None:
    for x in _LIBRARIES.values():
        x.clear()
        x.old = {}


_TABLES: dict[str, Table] = {}


def _table(sent: Sent) -> Table:
    if sent.id not in _TABLES:
        _TABLES.clear()
        _TABLES[sent.id] = Table(sent.value)
    return _TABLES[sent.id]


# ---- DataFrames


class Files:
    """A folder that ``write`` made: segments (part, segment, n_tokens, image), and beside them their frequency table,
    deflated, so that any session decodes them from the folder alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.segments = path, spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")

    def frequencies(self) -> np.ndarray:
        table = self.segments.sparkSession.read.schema("table binary").parquet(f"{self.path}/frequencies").first()["table"]
        return np.frombuffer(zlib.decompress(table), np.int64)


_SEGMENTS = "part int, segment int, n_tokens long, image binary"


def write(docs: DataFrame, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Files:
    """Segment files of the ids of all texts; see the module. path: a tokenizers JSON file."""
    spark = docs.sparkSession
    with open(path or default_path(), encoding="utf-8") as f:
        content = f.read()
    size = Library(content).size
    if not 0 <= end_id < size:
        raise ValueError(f"end id {end_id} is not in a vocabulary of {size}")
    library, kind = Sent(spark, content), np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def tokenize(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = _library(library).encode(b["t"])
        ends = np.cumsum(counts)
        return pa.RecordBatch.from_arrays([b["doc_id"], presplit.packed(np.insert(ids.astype(kind), ends, end_id), counts + 1).cast(pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    tokens = common.stored(common.mapped(rows, tokenize, "doc_id long, ids binary", _forget), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            seen += np.bincount(np.frombuffer(b"".join(b["ids"].to_pylist()), kind), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)  # a row for each id of the vocabulary
    for r in tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    frequencies = scaled(counts)
    sent = Sent(spark, frequencies)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, names, ids, have, wide = TaskContext.get().partitionId(), 0, [], [], 0, kind.itemsize

        def made() -> pa.RecordBatch:
            raw = segment_bytes(names, [len(x) // wide for x in ids], np.frombuffer(b"".join(ids), kind), _table(sent))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([have], pa.int64()), pa.array([raw], pa.binary())], names=["part", "segment", "n_tokens", "image"])

        for b in batches:
            for d, x in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if names and have + len(x) // wide > SEGMENT_IDS:
                    yield made()
                    segment, names, ids, have = segment + 1, [], [], 0
                names.append(d)
                ids.append(x)
                have += len(x) // wide
        if names:
            yield made()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids").asc()]  # the hash parts ids that many rows share
    ordered = tokens.repartitionByRange(n, *order).sortWithinPartitions(*order, "ids")
    folder = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    spark.createDataFrame([(zlib.compress(frequencies.astype(np.int64).tobytes()),)], "table binary").coalesce(1).write.parquet(f"{folder}/frequencies")
    ordered.mapInArrow(code, _SEGMENTS).write.parquet(f"{folder}/segments")
    return Files(spark, folder)


def read(files: Files) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit)."""
    spark, sent = files.segments.sparkSession, Sent(files.segments.sparkSession, files.frequencies())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, raw in zip(b["base"].to_pylist(), b["image"].to_pylist(), strict=True):
                names, counts, ids = read_segment(raw, _table(sent))
                ends = np.cumsum(counts, dtype=np.int64)
                data, at = ids.astype("<u4").tobytes(), 0
                for i in range(0, len(names), common.BATCH_ROWS):
                    some = slice(i, i + common.BATCH_ROWS)
                    starts = (ends[some] - counts[some]).tolist()
                    parts = [data[4 * a : 4 * z] for a, z in zip(starts, ends[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array([base + a for a in starts], pa.int64()), pa.array(parts, pa.binary())], names=["doc_id", "start", "ids"])

    sizes = files.segments.select("part", "segment", "n_tokens")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all"))  # a row for each range
    before = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    bases = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own")).join(before, "part").select("part", "segment", (F.col("before") + F.col("own")).alias("base"))
    return common.join_small(files.segments, bases, ["part", "segment"], "inner").select("base", "image").mapInArrow(decode, "doc_id long, start long, ids binary")


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids, written as segment files and read back."""
    common.small_batches(spark)
    got = read(write(common.read(spark, sf_dir, "documents")))
    return got.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
