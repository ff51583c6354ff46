"""Numbers of its own for rows that machines numbered each for themselves, carried through tables that refer to each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ordering
from tallyloom.plans.shared import cut


@dataclass
class Level:
    """rows: machine, id, the parent's id (if parent is the column's name) and content columns."""

    name: str
    rows: DataFrame
    parent: str | None = None


def remap(levels: list[Level]) -> DataFrame:
    """level, machine, id, new_id, new_parent, problem, for each row of every level, parents before children.

    A row is known by its machine and id; equal rows count once. New ids are dense, from 1, in the order of machine and id, whatever order
    the packages come in. An id with two contents is a problem (``two contents``, once) and gets no number; a row whose parent has none
    is an ``orphan`` and gets none either."""
    out, known = None, None
    for level in levels:
        once = level.rows.distinct()
        content = F.xxhash64(*once.columns), F.md5(F.to_json(F.struct(*once.columns)).cast("binary"))
        of = level.parent or "_none"
        each = (once if level.parent else once.withColumn("_none", F.lit(None).cast("long"))).withColumn("_content", F.struct(*content))
        each = each.groupBy("machine", "id").agg(F.countDistinct("_content").alias("_n"), F.min(of).alias(of))
        each = each.withColumn("problem", F.when(F.col("_n") > 1, "two contents"))
        if level.parent:
            each = each.join(known.select("machine", F.col("id").alias(of), F.col("new_id").alias("new_parent")), ["machine", of], "left")
            each = each.withColumn("problem", F.coalesce("problem", F.when(F.col("new_parent").isNull(), "orphan")))
        else:
            each = each.withColumn("new_parent", F.lit(None).cast("long"))
        each = cut(each)
        known = cut(ordering.numbered(each.where("problem IS NULL").select("machine", "id", "new_parent"), "machine", "id", name="new_id"))
        bad = each.where("problem IS NOT NULL").select(F.lit(level.name).alias("level"), "machine", "id", F.lit(None).cast("long").alias("new_id"), F.lit(None).cast("long").alias("new_parent"), "problem")
        good = known.select(F.lit(level.name).alias("level"), "machine", "id", "new_id", "new_parent", F.lit(None).cast("string").alias("problem"))
        out = good.union(bad) if out is None else out.union(good).union(bad)
    return out
