"""Total orders and running totals, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.shared import cut


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name, the sum over the rows before this one, of the same keys, in this order, which must tell
    a key's rows apart. Rows are dealt into ranges; sums run within each range, and what lies in earlier ranges of the same
    keys is added: a row for each range and key in it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_range", F.spark_partition_id()))
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = ranged.groupBy("_range", *keys).agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_range", *keys, *(zero(F.sum(f"_{k}").over(earlier)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({k: zero(F.sum(v).over(inside)) for k, v in sums.items()}).join(before, ["_range", *keys])
    return rows.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).select(*df.columns, *sums)


def numbered(df: DataFrame, *order: Column | str, name: str = "rn") -> DataFrame:
    """Adds a running number from 1 in this order, which must tell all rows apart."""
    return running(df, list(order), {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("long"))
