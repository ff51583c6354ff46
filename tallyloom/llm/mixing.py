"""Mixing sources to target weights: quotas, a multivariate-hypergeometric splitting tree, disjoint draws.

1. *Quotas.* Every source wants its weight's share of ``share`` times all words; what exceeds
   ``repeat`` times a source's words is shared again, by weight, among the others until none exceeds.
2. *Blocks.* A source's documents lie in a permuted order (md5 of the id), cut into ``blocks`` blocks by
   the first digits of that hash. Word counts of blocks give each block's offset in its source and,
   within a block, each document's; so no window ever holds a whole source, and a hot source is
   spread over its blocks. A quota is taken as whole passes over this order and a last, partial one:
   document by document, each source's taken words equal its quota (rounded down). With
   ``whole_documents`` the document at the end of a quota counts whole if at least half of it fits.
3. *Shards.* The splitting tree parts the vector of block counts (one per source: blocks of every
   pass that hold taken words) in two halves again and again; how many of each source's blocks go
   left is drawn from the multivariate hypergeometric law, from a generator seeded by the node, until
   each leaf is one output shard. Every shard then owns, of each source, a run of permuted blocks,
   disjoint from all others. Rows are shuffled within their shard by a hash.

What the driver holds is one row per source and shard (a catalogue's dimension: with a million sources about
half a gigabyte); documents are only joined and windowed. The plan of few sources is broadcast, that of more
than ``SOURCES_SENT`` joined by a shuffle.

Defined results: null text: size 0, takes nothing. A null source is a source, last in order. Sources
without words take nothing. Rows without an id are permuted by their texts. Repeated ids lie at the same place of the order, ties by size, and each row is drawn
on its own; extra columns are not read. Empty table: empty result. The same input always gives the same mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEAT = 2
#: Hex digits of the hash that name a block: 16 ** 3 blocks a source.
BLOCK_DIGITS = 3
SHARDS = 64
SOURCES_SENT = 10_000


def quotas(sizes: list[int], weights: list[float], share: float = SHARE, repeat: int = REPEAT) -> list[float]:
    """Target words of each source."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = min(share * sum(sizes), float(repeat * sum(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * left / total > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * left / total
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def split_tree(counts: list[int], shards: int, seed: int = 1) -> np.ndarray:
    """(shards, sources) block counts: rows sum to near-equal totals, columns to counts."""
    out = np.zeros((shards, len(counts)), np.int64)

    def part(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = have
            return
        middle, total = (low + high) // 2, int(have.sum())
        draw = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = np.zeros_like(have)
        rest, need = total, draw
        for i, n in enumerate(have.tolist()):  # the joint law, one source after another
            rest -= n
            left[i] = rng.hypergeometric(n, rest, need) if 0 < n and 0 < need and rest else min(n, need)
            need -= int(left[i])
        part(left, low, middle)
        part(have - left, middle, high)

    if len(counts):
        part(np.array(counts, np.int64), 0, shards)
    return out


def _permuted(doc_id: Column) -> Column:
    return F.md5(doc_id.cast("string").cast("binary"))


def _owner(number: Column, shards: int) -> Column:
    """The shard whose run holds a source's draw of this number."""
    return F.least(F.size(F.filter("_ends", lambda end: end <= number)), F.lit(shards - 1)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, shards: int = SHARDS, whole_documents: bool = False, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_key: Column | None = None, sent: int = SOURCES_SENT) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and ``draws``: an array of
    (pass, words, shard) of each pass that takes words of it; row_key, if one is given. sent: sources whose plan is
    broadcast, at most."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"), common.n_words(F.col(text_col)).alias("size"), (F.lit(0).cast("long") if row_key is None else row_key).alias("row_key"), F.when(F.col(id_col).isNull(), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))).alias("_own"))
    # a join key that null sources share and that no name equals
    rows = rows.select("doc_id", "size", "row_key", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")).alias("_key"), _permuted(F.coalesce(F.col("doc_id").cast("string"), F.col("_own"))).alias("_at"))
    rows = rows.withColumn("_block", F.substring("_at", 1, BLOCK_DIGITS))
    blocks = common.cut(rows.groupBy("_key", "_block").agg(F.sum("size").alias("_words")))
    found = sorted(blocks.groupBy("_key").agg(F.sum("_words").alias("n")).collect(), key=lambda r: (r["_key"] == "", r["_key"].encode()))
    sizes = [r["n"] for r in found]
    targets = quotas(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, repeat)
    plan = spark.createDataFrame([(r["_key"], n, int(t)) for r, n, t in zip(found, sizes, targets, strict=True)], "_key string, source_size long, _quota long")

    before = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum("_words").over(before), F.lit(0))).withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy("_block")) - 1)
    spans = common.join_small(blocks, plan, ["_key"], "inner", sent)
    used = spans.groupBy("_key").agg(*(F.sum(F.when(F.col("_quota") - p * F.col("source_size") > F.col("_offset"), F.when(F.col("_words") > 0, 1).otherwise(0)).otherwise(0)).alias(f"p{p}") for p in range(repeat))).collect()
    passes = {r["_key"]: [r[f"p{p}"] for p in range(repeat)] for r in used}
    tree = split_tree([sum(passes[r["_key"]]) for r in found], shards)
    plan = spark.createDataFrame(
        [(r["_key"], n, t, int(t), np.cumsum(tree[:, i]).tolist(), passes[r["_key"]]) for i, (r, n, t) in enumerate(zip(found, sizes, targets, strict=True))],
        "_key string, source_size long, target double, _quota long, _ends array<long>, _used array<long>",
    )

    inside = Window.partitionBy("_key", "_block").orderBy("_at", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(blocks.drop("_words"), ["_key", "_block"])  # dealt by these keys already
    rows = common.join_small(rows, plan, ["_key"], "inner", sent)  # a row for each source
    draws = []
    for p in range(repeat):
        room = F.col("_quota") - F.lit(p) * F.col("source_size") - F.col("_offset") - F.col("_inside")
        words = F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long")
        if whole_documents:
            words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
        # the block's number among the source's draws, and the shard whose run holds it
        number = F.col("_nth") + sum((F.col("_used")[q] for q in range(p)), F.lit(0))
        draws.append(F.struct(F.lit(p).alias("pass"), words.alias("words"), _owner(number, shards).alias("shard")))
    rows = rows.withColumn("draws", F.filter(F.array(*draws), lambda d: d["words"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws", *([] if row_key is None else ["row_key"]))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mixture itself: whole documents, once for each pass that takes them, dealt to their shards
    and in hashed order within each; the columns of docs. Draws belong to rows: of equal rows, which can't be
    told apart, one is laid out as often as they are drawn together."""
    row_key = F.xxhash64(*common.columns(docs))
    draws = mix(docs, whole_documents=True, id_col=id_col, row_key=row_key, **how).where(F.size("draws") > 0)
    draws = draws.select("doc_id", "row_key", F.explode("draws").alias("_d"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = draws.select(F.col("doc_id").alias("id"), F.col("row_key").alias("own"), F.col("_d.pass").alias("pass"), F.col("_d.shard").alias("shard"))
    whole = docs.select(F.struct(*common.columns(docs)).alias("row"), row_key.alias("own"))  # whatever else docs has can't clash
    whole = whole.groupBy("own").agg(F.first("row").alias("row"))
    out = whole.join(draws, "own")
    # a shard lies in a few pieces, so that few shards still spread evenly over many tasks
    return out.repartition(n, "shard", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("shard", F.xxhash64("id", "pass"), "id").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; one row per document, with the shards that its draws go to."""
    return mix(common.read(spark, sf_dir, "documents"))


def mixing_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_mixing without the seeded draws: what SQL can express."""
    return op8_mixing(spark, sf_dir).drop("draws")


QUOTAS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS w
  FROM d GROUP BY source
), fill(step, source, source_size, w, target, lft) AS (
  SELECT 0, source, source_size, w, CAST(NULL AS DOUBLE), least(1.5 * sum(source_size) OVER (), 2.0 * sum(source_size) OVER ())::DOUBLE FROM s
  UNION ALL
  SELECT step + 1, source, source_size, w, t, lft - coalesce(sum(CASE WHEN target IS NULL THEN t END) OVER (), 0) FROM (
    SELECT *, CASE WHEN target IS NOT NULL THEN target
      WHEN source_size = 0 THEN 0
      WHEN w * lft / sum(CASE WHEN target IS NULL AND source_size > 0 THEN w END) OVER () > 2 * source_size THEN 2.0 * source_size
      ELSE NULL END AS t
    FROM fill WHERE step < 60)
), last AS (
  SELECT source, source_size, coalesce(target, w * lft / sum(CASE WHEN target IS NULL THEN w END) OVER ()) AS target FROM fill WHERE step = 60
), o AS (
  SELECT d.doc_id, d.size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN last ON d.source IS NOT DISTINCT FROM last.source
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)) AS BIGINT) AS taken
FROM o
"""
