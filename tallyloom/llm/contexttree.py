"""Language-model scoring by context-tree weighting.

A text is the bytes of its words (A-Z lowered), joined by a space, and one line feed at the end. A byte is eight binary
decisions, high bit first: 255 inner nodes of a code tree. Each node has a context tree of its own over the
``DEPTH`` = 5 bytes before (line feeds before the first byte). A context's zeros a and ones b of the training texts have the
Krichevsky-Trofimov probability KT(a, b); the weighted probability of a context is P = KT at the full depth, and half KT
plus half the product of its longer contexts' P above. A decision's probability mixes the estimates (a + 1/2) / (a + b + 1)
of all depths: a context of weight w = KT / 2P gives w of its own estimate and 1 - w of the next longer context's.
A text's score is the log10 of the product over all its bytes' decisions. Nothing is pruned or capped; the model stays as
trained while texts are scored.

*Steps.*
1. A task takes its texts in parts of about ``PART`` bytes. For each part it gives the distinct (context, byte)
   keys with their training counts (0 where only held-out texts have them), the distinct words likewise, and the
   texts, compressed. All is kept in the shared folder, so that a lost executor repeats a part as it was.
2. Counts are added up by key. A key starts with the latest byte, so sorted keys hold whole subtrees. Contexts of three
   bytes and more are worked out along sorted keys, subtree by subtree (at most 2**24 keys each, dealt by two bytes and a
   remainder of the third); those of two bytes and less from their sums (at most 65,536 contexts, by latest byte; the root's
   255 nodes alone pass the driver). Going down again, every key gets its log-probability.
3. Keys' and words' figures go back to the parts that have them, where the texts are looked up in sorted arrays.
   So what is shuffled are distinct keys of parts, never positions, and no model is broadcast.

Defined results: null and empty texts have one token, the end, and one byte. A null id has no remainder: held_out is null,
and its text is scored but not learned from. Repeated rows count each and come back each. Without training texts every
decision is a half. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEPTH = 5
#: Bytes of text whose distinct keys are looked up together, and those worked on at once.
PART, PIECE = 64 << 20, 1 << 20
#: Keys of whole subtrees that are worked out at once, about.
KEYS = 1 << 18
END = b"\n"
#: Slices of a two-byte context's keys.
SLICES = 8
_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1/2 and more: Stirling's series, from 8 on."""
    low = x < 8
    z = np.where(low, x + 8, x)
    shift = np.ones_like(z)
    for i in range(8):
        shift = np.where(low, shift * (x + i), shift)
    s = 1 / (z * z)
    series = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return np.where(a + b > 0, log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi), 0.0)


class Weighted:
    """Contexts of one depth: log P, own weight w, its complement, and the estimates of both decisions."""

    def __init__(self, a: np.ndarray, b: np.ndarray, longer: np.ndarray | None) -> None:
        own = log_kt(a, b)
        if longer is None:  # full depth
            self.log, self.w, self.rest = own, np.ones_like(own), np.zeros_like(own)
        else:
            self.log = np.logaddexp(_HALF + own, _HALF + longer)
            self.w, self.rest = np.exp(_HALF + own - self.log), np.exp(_HALF + longer - self.log)
        self.estimate = np.stack((a + 0.5, b + 0.5)) / (a + b + 1)


def keys_of(x: np.ndarray) -> np.ndarray:
    """Keys of all bytes but the first DEPTH, which are context only: the five bytes before, latest first, then the byte."""
    padded = np.concatenate((np.zeros(8 - DEPTH - 1, np.uint8), x))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(x) - DEPTH,), (1,))  # the byte, on top, and the seven before
    out = eight << np.uint64(8)
    out >>= np.uint64(64 - 8 * DEPTH)
    out <<= np.uint64(8)
    out |= eight >> np.uint64(56)
    return out.view(np.int64)


class Lookup:
    """Places of keys in a sorted array: a table by a hash says where most are, a search finds the others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.shift = keys, np.uint64(64 - max(10, int(len(keys)).bit_length() + 2))
        self.table = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.table[self._slots(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slots(self, k: np.ndarray) -> np.ndarray:
        return (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, k: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(k)]
        other = np.flatnonzero(self.keys[at] != k)
        at[other] = np.searchsorted(self.keys, k[other])
        return at


class Places(dict):
    """word -> its number, in the order of first asking."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + END  # bytes: lowers A-Z, splits on ASCII white space


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of normalised texts, PIECE at a time: keys, and where which text's keys start."""
    pad = END * DEPTH
    buffer = np.frombuffer(pad + pad.join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + DEPTH for t in texts)])  # of a text's bytes, as positions of keys
    for at in range(0, len(buffer) - DEPTH, PIECE):
        keys = keys_of(buffer[at : at + PIECE + DEPTH])
        first = int(np.searchsorted(starts, at, "right")) - 1
        last = int(np.searchsorted(starts, at + len(keys), "left"))
        begins = np.maximum(starts[first:last] - at, 0)
        ends = np.minimum(starts[first + 1 : last + 1] - DEPTH - at, len(keys))
        some = ends > begins
        which, begins, ends = np.arange(first, last)[some], begins[some], ends[some]
        inside = np.ones(len(keys), bool)
        gaps = (starts[first : last + 1, None] - np.arange(1, DEPTH + 1) - at).ravel()  # the pads between texts
        inside[gaps[(gaps >= 0) & (gaps < len(keys))]] = False
        yield keys[inside], which, np.cumsum([0, *(ends - begins)[:-1]])


def _added(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


GATHERED = "part long, key long, word binary, n long, payload binary, kind int"
_KEY, _WORD, _TEXT = range(3)


def _packed(ids: list, held: list) -> bytes:
    """Count, ids, and for each id whether it is null, for each held likewise or its value."""
    given = np.array([i if i is not None else 0 for i in ids], np.int64)
    marks = np.array([[i is None, 2 if h is None else h] for i, h in zip(ids, held, strict=True)], np.uint8)
    return len(ids).to_bytes(8, "little") + given.tobytes() + marks.tobytes()


def _unpacked(raw: bytes) -> tuple[list, list, list[bytes]]:
    n = int.from_bytes(raw[:8], "little")
    ids, marks = np.frombuffer(raw, np.int64, n, 8).tolist(), np.frombuffer(raw, np.uint8, 2 * n, 8 + 8 * n).reshape(n, 2).tolist()
    texts = [t + END for t in raw[8 + 10 * n :].split(END)[:-1]]
    return [None if m[0] else i for i, m in zip(ids, marks, strict=True)], [None if m[1] > 1 else bool(m[1]) for m in marks], texts


class Part:
    """What a task holds of a part: distinct keys and words with their counts, compressed texts."""

    def __init__(self, number: int) -> None:
        self.number, self.size, self.waiting = number, 0, 0
        self.keys, self.counts, self.words, self.texts = [], [], Counter(), []

    def add(self, ids: list, held: list, learn: list[bool], texts: list[bytes]) -> None:
        done = [normalised(t) for t in texts]
        for t, y in zip(done, learn, strict=True):
            words = t.split()
            if y:
                self.words.update(words)
                self.words[END] += 1
            else:
                self.words.update(dict.fromkeys(words, 0))
                self.words[END] += 0
        for chosen in (True, False):
            for keys, _, _ in windows([t for t, y in zip(done, learn, strict=True) if y == chosen]):
                found, n = np.unique(keys, return_counts=True)
                self.keys.append(found)
                self.counts.append(n * chosen)
                self.waiting += len(found)
        if self.waiting > 1 << 21:
            self.merge()
        joined = b"".join(done)
        self.size += len(joined)
        self.texts.append(zstandard.compress(_packed(ids, held) + joined, 3))

    def merge(self) -> None:
        k, c = _added(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [k], [c], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.keys[0]), 1 << 17):
            yield self._made(_KEY, key=pa.array(self.keys[0][at : at + (1 << 17)]), n=pa.array(self.counts[0][at : at + (1 << 17)]))
        words = list(self.words.items())  # in the order of their first places
        for at in range(0, len(words), 1 << 14):
            some = words[at : at + (1 << 14)]
            yield self._made(_WORD, key=pa.array(range(at, at + len(some)), pa.int64()), word=pa.array([w for w, _ in some], pa.binary()), n=pa.array([n for _, n in some], pa.int64()))
        for i, payload in enumerate(self.texts):
            yield self._made(_TEXT, key=pa.array([i], pa.int64()), payload=pa.array([payload], pa.binary()))

    def _made(self, kind: int, **given: pa.Array) -> pa.RecordBatch:
        n = len(given["key"])
        types = {"word": pa.binary(), "n": pa.int64(), "payload": pa.binary()}
        columns = {"part": pa.array([self.number] * n, pa.int64()), "key": given["key"]} | {c: given.get(c, pa.nulls(n, t)) for c, t in types.items()} | {"kind": pa.array([kind] * n, pa.int32())}
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def gathered(docs: DataFrame, held: Column, id_col: str, text_col: str, part: int = PART) -> DataFrame:
    """Step 1, stored. held: true, false, or null (scored, but neither held out nor learned from)."""
    spark = docs.sparkSession
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        now = Part(number)
        for b in batches:
            held = b["held"].to_pylist()
            now.add(b["id"].to_pylist(), held, [h is False for h in held], common.texts(b["text"]))
            if now.size >= part:
                yield from now.rows()
                number += 1
                now = Part(number)
        if now.texts:
            yield from now.rows()

    path = f"{common.shared_dir(spark)}/contexts-{uuid.uuid4().hex}"
    docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).alias("text")).mapInArrow(run, GATHERED).write.partitionBy("kind").parquet(path)
    return spark.read.schema(GATHERED).parquet(path)


def _subtrees(keys: np.ndarray, n: np.ndarray, level: int) -> tuple:
    """Contexts of full depth up to three bytes at one of the eight decisions, for sorted keys. For each depth, from the
    longest: ids (context, then the bits so far), Weighted, and zeros and ones; and each key's place among them."""
    bit = keys >> (7 - level) & 1
    ids = keys >> (8 - level)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    at = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))
    ids, a, b = ids[first], np.add.reduceat(n * (1 - bit), first), np.add.reduceat(n * bit, first)
    now = Weighted(a, b, None)
    out, places = [(ids, now, a, b)], [at]
    for _ in range(DEPTH - 3):
        up = ids >> (level + 8) << level | ids & ((1 << level) - 1)
        ids, back = np.unique(up, return_inverse=True)
        a, b = (np.bincount(back, x, len(ids)) for x in (a, b))
        now = Weighted(a, b, np.bincount(back, now.log, len(ids)))
        at = back[at]
        out.append((ids, now, a, b))
        places.append(at)
    return bit, out, places


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Keys of whole subtrees of three bytes, their counts, and which of the rows above they belong to. Rows are sorted by
    slice; a slice's row above (key -1) comes first."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    above: list[bytes] = []
    size, enough = 0, KEYS

    def given(rows: list) -> tuple:
        return tuple(np.concatenate([r[i] for r in rows]) for i in range(3))

    for b in batches:
        keys, n = b["key"].to_numpy(), b["n"].to_numpy()
        heads = np.flatnonzero(keys < 0)
        of = np.cumsum(keys < 0) + len(above) - 1
        above += [b["above"][int(i)].as_py() for i in heads]
        rows = keys >= 0
        held.append((keys[rows], n[rows], of[rows]))
        size += int(rows.sum())
        if size >= enough or len(above) > 4_000:
            k, c, o = given(held)
            tree = o << 8 | k >> 24 & 255  # a slice's keys of one third byte
            other = np.flatnonzero(tree != tree[-1]) if len(tree) else tree
            if len(other):
                cut = int(other[-1]) + 1
                yield k[:cut], c[:cut], o[:cut], above
                first = int(o[cut])
                k, c, o, above = k[cut:], c[cut:], o[cut:] - first, above[first:]
            held, size, enough = [(k, c, o)], len(k), max(KEYS, 2 * len(k))
    k, c, o = given(held) if held else (np.empty(0, np.int64),) * 3
    if len(k):
        yield k, c, o, above


def _sliced(counts: DataFrame, above: DataFrame | None) -> DataFrame:
    """Rows (key, n, above), dealt and sorted by slice."""
    two, third = F.shiftright("key", 32), F.pmod(F.shiftright("key", 24), F.lit(SLICES)).cast("int")
    rows = counts.select(two.alias("two"), third.alias("third"), "key", "n", F.lit(None).cast("binary").alias("above"))
    if above is None:
        heads = rows.select("two", "third").distinct().select("two", "third", F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("above"))
    else:
        heads = rows.select("two", "third").distinct().join(above, "two").select("two", "third", F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "above")
    return rows.union(heads).repartition("two", "third").sortWithinPartitions("two", "third", "key").select("key", "n", "above")


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-byte contexts' sums over their three-byte ones."""
    for keys, n, _, _ in _whole(batches):
        for level in range(8):
            _, depths, _ = _subtrees(keys, n, level)
            ids, w, a, b = depths[-1]
            up, back = np.unique(ids >> (level + 8) << level | ids & ((1 << level) - 1), return_inverse=True)
            sums = [np.bincount(back, x, len(up)) for x in (a, b, w.log)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(up >> level), pa.array((1 << level | up & ((1 << level) - 1)).astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in sums[:2]), pa.array(sums[2])],
                names=["two", "node", "a", "b", "longer"],
            )


def _pair(rows: pd.DataFrame) -> tuple[Weighted, Weighted]:
    """All two-byte contexts (by their second byte and node) and the one-byte context of one latest byte."""
    a, b, longer = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    at = rows["two"].to_numpy() & 255, rows["node"].to_numpy()
    a[at], b[at], longer[at] = rows["a"], rows["b"], rows["longer"]
    two = Weighted(a, b, longer)
    return two, Weighted(a.sum(axis=0), b.sum(axis=0), two.log.sum(axis=0))


def log_probabilities(counts: DataFrame) -> DataFrame:
    """key, p: the log10 probability of each key's byte after its context. counts: key, n (0 for what is to be looked up only)."""
    spark = counts.sparkSession
    sums = _sliced(counts, None).mapInArrow(_up, "two long, node int, a long, b long, longer double")
    sums = common.cut(sums.groupBy("two", "node").agg(*(F.sum(c).alias(c) for c in ("a", "b", "longer"))).withColumn("one", F.shiftright("two", 8)))

    def ones(rows: pd.DataFrame) -> pd.DataFrame:
        _, one = _pair(rows)
        a, b = (np.bincount(rows["node"], rows[c], 256) for c in ("a", "b"))
        return pd.DataFrame({"node": range(256), "a": a, "b": b, "longer": one.log})

    found = sums.groupBy("one").applyInPandas(ones, "node int, a double, b double, longer double").groupBy("node").agg(*(F.sum(c) for c in ("a", "b", "longer"))).orderBy("node").collect()
    root = Weighted(*(np.array([r[i] for r in found] if found else [0.0] * 256) for i in (1, 2, 3)))

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        two, one = _pair(rows)
        own = root.w * root.estimate + root.rest * one.w * one.estimate
        mixed = own[None] + (root.rest * one.rest * two.w)[:, None] * two.estimate.transpose(1, 0, 2)
        rest = (root.rest * one.rest * two.rest)[:, None]
        table = np.concatenate((mixed, rest), axis=1)  # by second byte: both decisions' mixtures so far, what is left
        seen = np.unique(rows["two"])
        return pd.DataFrame({"two": seen, "above": [table[t & 255].tobytes() for t in seen]})

    above = sums.groupBy("one").applyInPandas(down, "two long, above binary")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n, of, heads in _whole(batches):
            tables, out = np.frombuffer(b"".join(heads), float).reshape(len(heads), 3, 256), np.zeros(len(keys))
            for level in range(8):
                bit, depths, places = _subtrees(keys, n, level)
                p = 0.0
                for (_, w, _, _), at in zip(depths, places, strict=True):
                    p = w.w[at] * w.estimate[bit, at] + w.rest[at] * p
                node = 1 << level | (keys & 255) >> (8 - level)
                out += np.log10(tables[of, bit, node] + tables[of, 2, node] * p)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(out)], names=["key", "p"])

    return _sliced(counts, above).mapInArrow(scored, "key long, p double")


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


def _lookup(total: int, distinct: int):
    """Step 3: rows of a part are its keys, its words' counts by the words' first places, then its texts in order."""
    scale = np.log10(total + 0.1 * (distinct + 1))

    def scored(payload: bytes, find: Lookup, p: np.ndarray, places: Places, figures: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        ids, held, texts = _unpacked(zstandard.decompress(payload))
        score, base, tokens, known = np.zeros(len(texts)), np.zeros(len(texts)), [], np.zeros(len(texts), np.int64)
        for k, which, starts in windows(texts):
            score[which] += np.add.reduceat(p[find(k)], starts)
        for i, t in enumerate(texts):
            found = [*t.split(), END]
            tokens.append(len(found))
            at = np.fromiter(map(places.__getitem__, found), np.int64, len(found))
            base[i] = figures[at].sum() - scale * len(found)
            known[i] = seen[at].sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(known), pa.array([len(t) for t in texts], pa.int64()), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"],
        )

    def ordered(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        k, p = (np.concatenate([r[i] for r in rows]) for i in (0, 1))
        order = np.argsort(k)
        return k[order], p[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, False
        for b in batches:
            part, kind = b["part"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), [True])))
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                rows = b.slice(at, end - at)
                if part[at] != now:
                    now, ready, held = part[at], False, {_KEY: [], _WORD: []}
                if kind[at] != _TEXT:
                    held[int(kind[at])].append((rows["key"].to_numpy(), rows["p"].to_numpy()))
                else:
                    if not ready:
                        (keys, p), (_, counts) = ordered(held[_KEY]), ordered(held[_WORD])
                        find, places, figures, ready = Lookup(keys), Places(), np.log10(counts + 0.1), True
                        held.clear()
                    for payload in rows["payload"].to_pylist():
                        yield scored(payload, find, p, places, figures, counts > 0)

    return run


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_bytes, train_tokens, base_score (unigram), score, bits_per_byte."""
    made = gathered(docs, held, id_col, text_col, part)
    keys, words, each = made.where(F.col("kind") == _KEY), made.where(F.col("kind") == _WORD), Window.partitionBy("word")
    counts = common.stored(keys.groupBy("key").agg(F.sum("n").alias("n")), "context-counts")
    model = common.stored(log_probabilities(counts), "context-model")
    counted = words.select("part", "key", "n", F.sum("n").over(each).alias("c"), F.row_number().over(each.orderBy("part")).alias("nth"))
    counted = common.stored(counted.select("part", "key", "c", "n", (F.col("nth") == 1).alias("first")), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("first") & (F.col("c") > 0))).first()
    none = F.lit(None).cast("binary").alias("payload")
    sent = keys.select("part", "key").join(model, "key").select("part", F.lit(_KEY).alias("kind"), "key", "p", none)
    sent = sent.union(counted.select("part", F.lit(_WORD), "key", F.col("c").cast("double"), none))
    sent = sent.union(made.where(F.col("kind") == _TEXT).select("part", "kind", "key", F.lit(0.0), "payload"))
    out = sent.repartition("part").sortWithinPartitions("part", "kind", F.when(F.col("kind") == _TEXT, F.col("key"))).mapInArrow(_lookup(total, distinct), SCORED)
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.col("n_bytes")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "n_bytes", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op11_contexttree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"), common.fold(F.col("doc_id"), 10) == 0)
