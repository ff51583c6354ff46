"""Connected components by alternating large-star and small-star steps, each a join and an aggregation.

Every round links each node's larger neighbours to its smallest one, then its smaller ones, until the
links are stars around each component's smallest node. Rounds grow with the logarithm of the longest
path. Links stay distributed and are checkpointed in the shared folder each round; a node with very
many links is spread by partial aggregation and adaptive skew joins.

Defined results: self-links and repeated links change nothing; links with a null end are ignored; no
links give no rows. Result: (node, root) of every node that has a link to another, roots excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    m = _smallest(links)
    return links.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v")))


def _tidy(links: DataFrame) -> DataFrame:
    return common.cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    now = _tidy(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v")))
    seen = None
    for _ in range(rounds):
        # a sum of hashes tells whether the set of links is the one before
        mark = now.agg(F.count("u"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        now = _tidy(_small(_tidy(_large(now))))
    raise RuntimeError("components did not settle")
