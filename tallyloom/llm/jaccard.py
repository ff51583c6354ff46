"""Links between texts whose sets of five-word shingles are alike: Jaccard similarity of ``LEAST`` or more.

*Candidates.* A text's set is sketched by 64 minima under 64 orders of its shingles' hashes, in 16 bands
of 4. Sets that agree in a band meet: two sets of similarity s do with probability ``1 - (1 - s^4)^16``,
that is 0.9998 at 0.8 and more above. Bands with the same members are looked at once.

*Check.* Only sets that meet another one have their shingles made again and moved. Inside a band every link
is decided by the sets themselves, breadth-first: a set already reached is never compared again, and only
a spanning tree is emitted. A band of more than about ``MOST`` shingles is cut into blocks and each pair
of blocks compared: all pairs of the band are, and no task holds more than about two blocks and a text.

Defined results: words are those of SimHash (A-Z lowered, ASCII white space). Fewer than 5 words: one shingle of
all of them. Null and empty texts, and such of white space only, have no set and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
#: Shingles of one band that are compared at once.
MOST = 1 << 20
#: Distinct words whose hashes a Python worker remembers.
CACHE_WORDS = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def forget() -> None:
    _WORDS.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    words = text.lower().split()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n, k = max(len(h) - k + 1, 0) or min(len(h), 1), min(k, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : i + n])
    return np.unique(out)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of band keys for each set; none of them may be empty."""
    if not sets:
        return np.empty((0, BANDS), np.int64)
    every, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for i in range(BANDS):
        key = np.full(len(sets), i, np.uint64)
        for order in _ORDERS[i * ROWS : (i + 1) * ROWS]:
            key = _mixed(key + np.minimum.reduceat(every * order, starts))
        out[:, i] = key
    return out.view(np.int64)


def sketches(texts: list[bytes]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text: a hash of its set (null if it has none), the set's size and the band keys."""
    sets = [shingles(t) for t in texts]
    some = [len(s) > 0 for s in sets]
    keys = iter(bands([s for s in sets if len(s)]).tolist())
    names = [(xxhash.xxh3_64_intdigest(s.tobytes()) ^ 1 << 63) - (1 << 63) if len(s) else None for s in sets]
    return pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([next(keys) if ok else None for ok in some], pa.list_(pa.int64()))


def trees(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning tree of each group of linked sets, breadth-first. Sets are sorted and distinct."""
    sizes = np.array([len(s) for s in sets])
    _, every = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(every, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(every) and int(every.max()) + 1, bool)
    out, left = [], np.arange(len(sets))
    flat = every
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        flat = flat[len(own[root]) :]
        reached = [root]
        while reached and len(left):
            now = reached.pop()
            mark[own[now]] = True
            both = np.add.reduceat(mark[flat], np.cumsum([0, *sizes[left[:-1]]]), dtype=np.int64)
            mark[own[now]] = False
            near = both >= least * (sizes[now] + sizes[left] - both)
            if near.any():
                found = left[near].tolist()
                out += [(root, x) for x in found]
                reached += found
                flat = flat[np.repeat(~near, sizes[left])]
                left = left[~near]
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over (key, i, j, name, at) sorted by the first three."""

    def flush(names: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(sets) > 1 and (found := trees(sets)):
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], names=["a", "b"])

    now, names, sets = None, [], []
    for b in batches:
        for *run, name, at in zip(*(b[c].to_pylist() for c in ("key", "i", "j", "name")), b["at"], strict=True):
            if run != now:
                yield from flush(names, sets)
                now, names, sets = run, [], []
            names.append(name)
            sets.append(at.values.to_numpy().view(np.uint64))
    yield from flush(names, sets)


def links(sets: DataFrame, texts: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links between names of sets that connect all that are reachable. sets: (name, size, bands, text_key),
    distinct names, none null; texts: (text_key, text), which holds each set's text at least once."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = sets.select(F.explode("bands").alias("key"), "name", "size")
    met = keyed.groupBy("key").agg(F.count("name").alias("n"), F.bit_xor(F.xxhash64("name")).alias("who"), F.sum("size").alias("all")).where("n > 1")
    met = common.cut(met.groupBy("n", "who").agg(F.min("key").alias("key"), F.max("all").alias("all")).select("key", F.ceil(F.col("all") / most).cast("int").alias("blocks")))
    members = common.cut(common.join_small(keyed, met, ["key"], "inner").select("key", "name", "blocks"))
    wanted = common.cut(sets.select("name", "text_key").join(members.select("name").distinct(), "name"))
    rows = common.join_small(texts, wanted, ["text_key"], "inner").select("name", "text")
    made = common.mapped(
        rows,
        lambda b: pa.RecordBatch.from_arrays([b["name"], pa.array([shingles(t).view(np.int64) for t in common.texts(b["text"])], pa.list_(pa.int64()))], names=["name", "at"]),
        "name long, at array<long>",
        forget,
    ).dropDuplicates(["name"])
    own = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    pairs = members.select("key", "name", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name")
    dealt = pairs.join(made, "name").select("key", "i", "j", "name", "at").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compared, "a long, b long")
