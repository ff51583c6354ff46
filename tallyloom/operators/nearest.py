"""Each item's best partners among all items, by the tokens that they share: no list of a token is cut.

Items with the same tokens are one class, which is held against every other class once. Classes are dealt to query
blocks; every block meets all classes, in batches, and keeps the best few of each of its own. Work is quadratic in the
number of classes; memory of a task is not: a block, a batch and one table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import ordering
from tallyloom.plans import shared

#: Classes of a query block at most, and at least if there are tasks without any; counts of a table at most.
BLOCK, SMALL, TABLE = 32_768, 512, 1 << 23
#: Copies of one class are ranked in so many parts first.
PARTS = 64


def _incidence(tokens: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every token that is known."""
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), -1).to_numpy()
    row = pc.list_parent_indices(tokens).to_numpy()
    return row[code >= 0], code[code >= 0]


def _by_code(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by token, and where each token's begin."""
    return row[np.argsort(code, kind="stable")], np.r_[0, np.cumsum(np.bincount(code, minlength=size))]


def _shared(queries: tuple[np.ndarray, np.ndarray], n: int, others: tuple[np.ndarray, np.ndarray], m: int) -> np.ndarray:
    """n x m: how many tokens a query shares with another. Tokens that many pairs share go through one product of matrices, others are added one by one."""
    (row, begins), (column, starts) = queries, others
    pairs = np.diff(begins) * np.diff(starts)
    often, few = np.flatnonzero(pairs * 64 > n * m), np.flatnonzero((pairs > 0) & (pairs * 64 <= n * m))
    left, right = np.zeros((n, len(often)), np.float32), np.zeros((len(often), m), np.float32)
    for at, t in enumerate(often):
        left[row[begins[t] : begins[t + 1]], at] = 1
        right[at, column[starts[t] : starts[t + 1]]] = 1
    counts = left @ right
    for t in few:
        counts[np.ix_(row[begins[t] : begins[t + 1]], column[starts[t] : starts[t + 1]])] += 1
    return counts


def _kept(who: np.ndarray, score: np.ndarray, key: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For n queries, the k rows of the highest score, then of the smallest key; scores of 0 stand for none."""
    order = np.lexsort((key, -score, who))
    who, score, key = who[order], score[order], key[order]
    begins = np.searchsorted(who, np.arange(n))
    place = np.arange(len(who)) - begins[who]
    some = place < k
    scores, keys = np.zeros((n, k), np.float32), np.zeros((n, k), np.int64)
    scores[who[some], place[some]], keys[who[some], place[some]] = score[some], key[some]
    return scores, keys


def _nearest(k: int):
    """For the classes (own) of a task: the k classes that share the most tokens with each, then those of the smallest numbers. Rows (own, c, tokens) come
    in the order of own classes first, then of c, so that a later class never takes the place of one that shares as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, numbers, blocks, known = [], [], [], None
        for b in batches:
            own = b["own"].to_numpy(zero_copy_only=False)
            if own.any():
                mine.append(b.filter(b["own"]))
            if own.all():
                continue
            if known is None:  # all own ones have come
                if not mine:
                    return
                table = pa.Table.from_batches(mine)
                held = table["tokens"].combine_chunks()
                known, numbers = pc.unique(held.flatten()), table["c"].to_numpy()
                row, code = _incidence(held, known)
                size = max(1, TABLE // 10_000)
                for at in range(0, len(numbers), size):
                    inside = (row >= at) & (row < at + size)
                    n = min(size, len(numbers) - at)
                    blocks.append([n, _by_code(row[inside] - at, code[inside], len(known)), np.zeros((n, k), np.float32), np.zeros((n, k), np.int64)])
            others = b.filter(pc.invert(b["own"]))
            c = others["c"].to_numpy()
            column, code = _incidence(others["tokens"], known)
            columns = _by_code(column, code, len(known))
            for block in blocks:
                n, rows, scores, keys = block
                counts = _shared(rows, n, columns, len(c))
                better = counts > scores[:, -1:]
                hits = np.count_nonzero(better)
                if hits > 32 * n and len(c) > k:  # at first nearly all are: only the best of each query go on
                    rank = counts.astype(np.int64) * len(c) - np.arange(len(c))
                    to = np.argpartition(rank, len(c) - k, axis=1)[:, -k:].ravel()
                    who = np.repeat(np.arange(n), k)
                    some = better[who, to]
                    who, to = who[some], to[some]
                else:
                    who, to = np.nonzero(better)
                if hits:
                    touched, at = np.unique(who, return_inverse=True)
                    old = np.repeat(np.arange(len(touched)), k), scores[touched].ravel(), keys[touched].ravel()
                    scores[touched], keys[touched] = _kept(*(np.concatenate(x) for x in zip(old, (at, counts[who, to], c[to]), strict=True)), len(touched), k)
        at = 0
        for n, _, scores, keys in blocks:
            who, place = np.nonzero(scores)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[at + who], pa.int64()), pa.array(keys[who, place]), pa.array(scores[who, place].astype(np.int64))], names=["c", "other", "n"])
            at += n

    return run


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """c, tokens, some: rows with the same tokens, numbered in the order of their first ones, with their first k (who, ordinal)."""
    first = lambda df, *by: df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("who", "ordinal"))).where(F.col("_place") <= k).drop("_place")
    few = first(first(rows.withColumn("_part", F.pmod("ordinal", F.lit(PARTS))), "tokens", "_part"), "tokens")
    some = few.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("who", "ordinal"))).alias("some"))
    return ordering.numbered(some.withColumns({"_who": F.col("some")[0]["who"], "_ordinal": F.col("some")[0]["ordinal"]}), "_who", "_ordinal", name="c").select("c", "tokens", "some")


def pairs(items: DataFrame, tokens: str = "tokens", k: int = 6, identity: str = "identity") -> DataFrame:
    """a < b, score: each item with the k others that share the most tokens with it, at least one, ties by the others' identity, then ordinal; and
    how many they share. What an item finds does not depend on how many others have a token."""
    rows = items.select("ordinal", F.col(identity).alias("who"), F.array_sort(F.array_distinct(F.array_compact(F.col(tokens)))).alias("tokens"))
    rows = shared.cut(rows.where(F.size("tokens") > 0))
    classes = shared.cut(_classes(rows, k + 1))  # one more than k, as an item is among its own class
    n = classes.count()
    blocks = max(1, -(-n // BLOCK), min(-(-n // SMALL), 2 * items.sparkSession.sparkContext.defaultParallelism))
    block = lambda own: F.struct(F.lit(own).alias("own"), "c", "tokens")
    own = classes.select(F.pmod("c", F.lit(blocks)).cast("int").alias("block"), block(True).alias("x"))
    dealt = own.union(classes.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), block(False).alias("x")))
    dealt = dealt.repartitionById(blocks, "block").select("x.*").sortWithinPartitions(F.desc("own"), "c")
    near = shared.cut(dealt.mapInArrow(_nearest(k + 1), "c long, other long, n long"))
    # the best classes hold the best items, as classes are numbered by their first ones
    held = near.join(classes.select(F.col("c").alias("other"), "some"), "other").select("c", F.transform("some", lambda x: F.struct((-F.col("n")).alias("n"), x["who"].alias("who"), x["ordinal"].alias("ordinal"))).alias("found"))
    best = held.groupBy("c").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    best = shared.few(best.join(classes.select("c", "tokens"), "c").select("tokens", F.transform("found", lambda x: F.struct(x["ordinal"].alias("j"), (-x["n"]).alias("n"))).alias("found")))
    found = rows.join(best, "tokens").select("ordinal", F.explode(F.slice(F.filter("found", lambda x: x["j"] != F.col("ordinal")), 1, k)).alias("x"))
    return found.select(F.least("ordinal", "x.j").alias("a"), F.greatest("ordinal", "x.j").alias("b"), F.col("x.n").alias("score")).distinct()
