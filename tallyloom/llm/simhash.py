"""SimHash near-duplicates, with pigeonring filtering of candidates.

A fingerprint has a bit for each of 64 places: set if it is set in over half of the text's shingle
hashes. Two fingerprints link when at most ``BUDGET`` = 3 bits differ.

*Candidates.* Lay the fingerprint's 8 segments of 8 bits on a ring. If at most 3 bits differ, then from
some segment on, every chain of the next l segments has at most ``floor(3 l / 8)`` differing bits: 0 in
the first two, at most 1 in the first five, 2 in the first seven. So from that segment on, 16 bits are
equal, and of the next 24 at least one half of 12 is: a 28-bit key for each of 8 starts and 2 halves.
Fingerprints that share a key meet; the chain's cumulative budgets prune them before the full
Hamming check. All links are found (each at its own start).

*Scale.* Copies share one fingerprint and are looked at once. Keys are dealt by hash and sorted, so
that a task streams over runs of equal keys. Inside a run, links are found breadth-first: a
fingerprint already reached is never compared again, and only a spanning tree is emitted, so a group of
near copies gives as many rows as members, not pairs. A run of more than ``RUN`` fingerprints is set
aside as blocks, and a second pass compares each pair of its blocks: exact, and no task holds more than two
blocks. Components come from star contraction over these links (see ``components``).

Defined results: null and empty texts, and such of white space only, have fingerprint 0, linked like
any other. Fewer than 3 words: one shingle of all of them. Null ids are fingerprinted and take part, but
are never a component's id (a component of null ids only has id null). Repeated rows all come back.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard
from .components import components

SHINGLE, SEED, BUDGET = 3, 42, 3
#: Fingerprints of one key that are compared at once.
RUN = 16_384
_BITS = 100_000


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    words = text.lower().split()  # bytes: lowers A-Z, splits on ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        ends, starts = [len(joined)], [0]
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ends = (after[k - 1 :] - 1).tolist()
        starts = [0, *after[: len(ends) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BITS):
        ones += np.unpackbits(h[i : i + _BITS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return common.mapped(rows, lambda b: pa.RecordBatch.from_arrays([b["doc_id"], pa.array([fingerprint(t, k) for t in common.texts(b["t"])], pa.int64())], names=["doc_id", "fp"]), "doc_id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """(key, fp) for each start and half; the start is key >> 29."""
    keys = []
    for i in range(8):
        r = F.col("fp") if not i else F.shiftrightunsigned("fp", 8 * i).bitwiseOR(F.shiftleft("fp", 64 - 8 * i))
        near = r.bitwiseAND(F.lit((1 << 28) - 1))
        far = r.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(r, 28).bitwiseAND(F.lit(0xFFF)), 16))
        keys += [near.bitwiseOR(F.lit(2 * i << 28)), far.bitwiseOR(F.lit(2 * i + 1 << 28))]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _near(x: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Which differences x (uint64, segments' bits) keep the chain's budgets from this start, then the
    whole budget."""
    turn = np.uint64(8) * np.asarray(start, np.uint64)
    r = x >> turn | x << (np.uint64(64) - turn & np.uint64(63))
    out = np.bitwise_count(r & np.uint64(0xFFFFFFFFFF)) <= 5 * BUDGET // 8
    out &= np.bitwise_count(r & np.uint64(0xFFFFFFFFFFFFFF)) <= 7 * BUDGET // 8
    return out & (np.bitwise_count(r & np.uint64(0xFFFF)) == 0) & (np.bitwise_count(x) <= BUDGET)


def _trees(run: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning tree of each group of linked fingerprints of a run, breadth-first."""
    out, left = [], np.unique(run)
    while len(left) > 1:
        root, left = left[0], left[1:]
        reached = [root]
        while reached and len(left):
            near = _near(left ^ reached.pop(), start)
            if near.any():
                found = left[near]
                out += [(root, x) for x in found]
                reached += list(found)
                left = left[~near]
    return out


LINKS = "block int, key long, a long, b long"


def _made(block: list[int], key: list[int], a, b) -> pa.RecordBatch:
    signed = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(key, pa.int64()), signed(a), signed(b)], names=["block", "key", "a", "b"])


def _scan(most: int, groups: int):
    """Streams over rows sorted by their first ``groups`` columns (the first is the key), the last column
    being fp. Emits links (block -1), and the rows of runs of more than ``most`` with their block (0, 1, ...)."""

    def flush(parts: list[np.ndarray], key: int) -> Iterator[pa.RecordBatch]:
        run = np.concatenate(parts)
        if len(run) > 1 and (tree := _trees(run, key >> 29)):
            yield _made([-1] * len(tree), [key] * len(tree), [x for x, _ in tree], [y for _, y in tree])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, block = None, [], 0, 0  # the run that goes on, its rows not yet emitted
        for b in batches:
            if not b.num_rows:
                continue
            columns = [c.to_numpy() for c in b.columns[:groups]]
            fp = b.columns[groups].to_numpy().view(np.uint64)
            new = np.zeros(len(fp), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(fp)]
            pairs = [x for x in range(1, len(cuts) - 2) if cuts[x + 1] - cuts[x] == 2]
            if pairs:  # most runs that have links: two fingerprints
                at = np.array([cuts[x] for x in pairs])
                good = _near(fp[at] ^ fp[at + 1], columns[0][at] >> 29)
                at = at[good & (fp[at] != fp[at + 1])]
                if len(at):
                    yield _made([-1] * len(at), columns[0][at].tolist(), fp[at], fp[at + 1])
            for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                inner = 0 < i < len(cuts) - 2
                if inner and z - a <= 2:
                    continue
                name = tuple(int(c[a]) for c in columns)
                if name != now:
                    if held and block == 0:
                        yield from flush(held, now[0])
                    elif held:
                        yield _made([block] * size, [now[0]] * size, rows := np.concatenate(held), rows)
                    now, held, size, block = name, [], 0, 0
                held.append(fp[a:z])
                size += z - a
                while size > most:
                    rows = np.concatenate(held)
                    yield _made([block] * most, [name[0]] * most, rows[:most], rows[:most])
                    held, size, block = [rows[most:]], size - most, block + 1
        if held and block == 0:
            yield from flush(held, now[0])
        elif held:
            yield _made([block] * size, [now[0]] * size, rows := np.concatenate(held), rows)

    return scan


def links(fps: DataFrame, run: int = RUN) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are reachable. fps: (fp), distinct."""
    spark = fps.sparkSession
    common.small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.cut(_keyed(fps).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_scan(run, 1), LINKS))
    out = found.where("block = -1").select("a", "b")
    large = found.where("block >= 0")
    if large.limit(1).count():
        blocks = large.groupBy("key").agg(F.max("block").alias("last"))
        rows = common.join_small(large, blocks, ["key"], "inner")
        rows = rows.select("key", "block", F.explode(F.sequence(F.lit(0), "last")).alias("other"), F.col("a").alias("fp")).where("block <> other")
        rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
        second = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_scan(2 * run, 3), LINKS)
        out = out.union(second.select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, run: int = RUN) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach)."""
    common.small_batches(docs.sparkSession)
    each = common.cut(fingerprints(docs, id_col, text_col, k))
    fps = common.cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), run)).select(F.col("node").alias("fp"), "root")
    rooted = common.cut(fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(names, "root").select("fp", "component_id")
    return each.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(docs: DataFrame, text_col: str = "text", run: int = RUN, most: int = jaccard.MOST) -> DataFrame:
    """text_key (``xxhash64`` of the text), root: components over the links of fingerprints and, beside them, of
    five-word sets with a Jaccard similarity of 0.8 or more. Nodes are fingerprints: texts that share one are one."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = common.texts(b["text"])
        return pa.RecordBatch.from_arrays([b["text_key"], pa.array([fingerprint(t) for t in found], pa.int64()), *jaccard.sketches(found)], names=["text_key", "fp", "name", "size", "bands"])

    made = common.stored(common.mapped(texts, each, "text_key long, fp long, name long, size long, bands array<long>", jaccard.forget), "alike")
    of = common.cut(made.groupBy("text_key").agg(F.first("fp").alias("fp"), F.first("name").alias("name"), F.first("size").alias("size")))
    sets = of.where("name IS NOT NULL").groupBy("name").agg(F.min("fp").alias("of"), F.min("text_key").alias("text_key"), F.first("size").alias("size"))
    sets = common.cut(sets)
    banded = sets.join(made.select("name", "bands").dropDuplicates(["name"]), "name")
    found = jaccard.links(common.stored(banded, "sets"), texts, most)
    names = sets.select("name", "of")
    found = found.join(names.select(F.col("name").alias("a"), F.col("of").alias("x")), "a").join(names.select(F.col("name").alias("b"), F.col("of").alias("y")), "b").select("x", "y")
    same = of.join(names, "name").where("fp <> of").select("fp", "of")
    found = common.cut(found.union(same))
    roots = components(links(of.select("fp").distinct(), run).union(found)).select(F.col("node").alias("fp"), "root")
    return common.cut(of.join(roots, "fp", "left").select("text_key", F.coalesce("root", "fp").alias("root")))


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of alike texts: the smallest id, rows without one last; then by hashes of
    the text and of the whole row. Ids need not be distinct. Columns of docs."""
    keys = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.xxhash64(*common.columns(docs)).alias("row_key"))
    tagged = docs.select(F.struct(*common.columns(docs)).alias("_row"), keys.alias("_key"))
    each = tagged.select("_key", F.col("_key.text_key").alias("text_key"))
    firsts = each.join(alike(docs, text_col), "text_key").groupBy("root").agg(F.min("_key").alias("_key")).select("_key.text_key", "_key.row_key")
    tagged = tagged.select("_row", "_key.text_key", "_key.row_key")
    return tagged.join(firsts, ["text_key", "row_key"], "left_semi").dropDuplicates(["text_key", "row_key"]).select("_row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
