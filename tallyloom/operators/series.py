"""Sales inferred from daily stock: segments, dense days, carried stock, sales, roll-ups, ranking.

An offer's day has a shape: one default SKU, or several. A new segment begins whenever the shape
flips; sales never bridge a flip. Inside a segment and the asked range every SKU has each day: its
observation, else the last one before, else the latest before the range, else the earliest after its
start. Sales are how far stock fell since the day before; none on a segment's first day.
All steps are windows and joins by (shop, offer, ...), so work stays with the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import ordering

DEFAULT = "default"


def freeze(inventory: DataFrame, start: str, end: str, cap: bool = False) -> DataFrame:
    """All history of offers with a valid observation in the range; with cap, none after its end."""
    valid = inventory.where(F.col("stock").isNotNull())
    asked = valid.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("shop", "offer").distinct()
    rows = valid.join(asked, ["shop", "offer"], "left_semi")
    return rows.where(F.col("date") <= F.lit(end).cast("date")) if cap else rows


def segments(rows: DataFrame, start: str, end: str) -> DataFrame:
    """shop, offer, segment, is_default, begins, low, high: the days of each segment inside the range;
    a day with both shapes counts as default."""
    days = rows.groupBy("shop", "offer", "date").agg(F.max(F.col("sku") == DEFAULT).alias("is_default"))
    by_offer = Window.partitionBy("shop", "offer").orderBy("date")
    days = days.withColumn("flip", F.coalesce((F.lag("is_default").over(by_offer) != F.col("is_default")).cast("int"), F.lit(0)))
    days = days.withColumn("segment", F.sum("flip").over(by_offer))
    found = days.groupBy("shop", "offer", "segment").agg(F.min("date").alias("begins"), F.first("is_default").alias("is_default"))
    after = Window.partitionBy("shop", "offer").orderBy("segment")
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    found = found.withColumn("low", F.when(F.row_number().over(after) == 1, low).otherwise(F.greatest(low, "begins")))
    found = found.withColumn("high", F.least(high, F.coalesce(F.date_sub(F.lead("begins").over(after), 1), high)))
    return found


def sku_series(inventory: DataFrame, start: str, end: str, cap: bool = False) -> DataFrame:
    """shop, offer, sku, segment, date, stock, sales, color: a row for each day a SKU is active.

    One scan: all windows and groups follow from one dealing by (shop, offer)."""
    low_day, high_day = F.lit(start).cast("date"), F.lit(end).cast("date")
    offer = Window.partitionBy("shop", "offer")
    rows = inventory.where(F.col("stock").isNotNull()).withColumn("_asked", F.max(F.col("date").between(low_day, high_day)).over(offer)).where("_asked")
    if cap:
        rows = rows.where(F.col("date") <= high_day)
    # a day has one shape, so it only flips from a day's last row to the next day's first
    shape = F.max(F.col("sku") == DEFAULT).over(Window.partitionBy("shop", "offer", "date"))
    by_row = offer.orderBy("date", "sku")
    rows = rows.withColumn("_shape", shape).withColumn("_flip", F.coalesce((F.lag("_shape").over(by_row) != F.col("_shape")).cast("int"), F.lit(0)))
    rows = rows.withColumn("segment", F.sum("_flip").over(by_row.rowsBetween(Window.unboundedPreceding, 0)))
    by_segment = offer.orderBy("segment")
    rows = rows.withColumn("begins", F.min("date").over(Window.partitionBy("shop", "offer", "segment"))).withColumn("_until", F.min("date").over(by_segment.rangeBetween(1, 1)))
    low = F.when(F.col("segment") == 0, low_day).otherwise(F.greatest(low_day, "begins"))
    rows = rows.withColumn("low", low).withColumn("high", F.least(high_day, F.coalesce(F.date_sub("_until", 1), high_day))).where("low <= high")
    keys = ["shop", "offer", "segment", "sku"]
    before, later = F.col("date") < F.col("low"), F.col("date") > F.col("low")
    facts = rows.groupBy(*keys, "begins", "low", "high").agg(
        F.min("date").alias("first"), F.max_by("stock", F.when(before, F.col("date"))).alias("prior"), F.min_by("stock", F.when(later, F.col("date"))).alias("next"),
        F.array_sort(F.collect_list(F.struct("date", "stock"))).alias("_days"),
    )
    # a day that is there twice counts with its larger stock
    once = F.filter("_days", lambda x, i: F.coalesce(F.get("_days", i + 1)["date"] != x["date"], F.lit(True)))
    facts = facts.withColumn("seen", F.map_from_entries(once)).drop("_days")
    line = facts.withColumn("date", F.explode(F.sequence("low", "high"))).withColumn("actual", F.try_element_at("seen", F.col("date"))).drop("seen")
    w = Window.partitionBy(*keys).orderBy("date")
    carried = F.last("actual", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    line = line.withColumn("stock", F.coalesce(carried, "prior", "next"))
    previous = F.lag("stock").over(w)
    line = line.withColumn("sales", F.when(previous.isNull() | (F.col("date") == low_day), F.lit(0)).otherwise(F.greatest(previous - F.col("stock"), F.lit(0))).cast("long"))
    line = line.withColumn("color", F.when(F.col("actual").isNull(), "yellow").when(previous < F.col("stock"), "red").otherwise("green"))
    # a SKU first seen after its segment began has no days before
    line = line.where((F.col("first") <= F.col("begins")) | (F.col("date") >= F.greatest("low", "first")))
    return line.select(*keys, "date", "stock", "sales", "color")


def roll_up(series: DataFrame, *level: str) -> DataFrame:
    """Stock, sales and color of all series of a level and day: sums, and red if any is red."""
    red = F.when(F.max((F.col("color") == "red").cast("int")) == 1, "red").otherwise("green")
    return series.groupBy(*level, "date").agg(F.sum("stock").cast("long").alias("stock"), F.sum("sales").cast("long").alias("sales"), red.alias("color"))


def totals(series: DataFrame) -> DataFrame:
    """Sales of SKUs, of their offers and of their shops, from one pass."""
    sets = series.rollup("shop", "offer", "sku").agg(F.sum("sales").cast("long").alias("sales"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, "sku").when(F.col("_g") == 1, "offer").when(F.col("_g") == 3, "shop").otherwise("all")
    return sets.select(level.alias("level"), "shop", "offer", "sku", "sales")


def switches(parts: DataFrame) -> DataFrame:
    """Visible starts of later segments: only after an earlier visible one."""
    seen = parts.where("low <= high")
    nth = F.row_number().over(Window.partitionBy("shop", "offer").orderBy("segment"))
    return seen.withColumn("_n", nth).where("_n > 1").select("shop", "offer", F.col("low").alias("date"), "is_default")


def rank(groups: DataFrame, by: Column, *ties: str) -> DataFrame:
    """Adds rank: a total order over groups (already aggregated: one row for each)."""
    return ordering.numbered(groups, by, *ties, name="rank")
