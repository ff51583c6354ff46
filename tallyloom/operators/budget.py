"""Which calls a budget lets through, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ordering

MONEY = "decimal(28,12)"


def cost(rows: DataFrame) -> DataFrame:
    """Adds cost: null if the usage or the model's price isn't known. rows: prompt, completion, hit, miss (tokens), input_rate, cached_rate,
    output_rate (a million tokens; null for an unknown model). Hits and misses must make up the prompt, unless both cost the same."""
    same = F.col("input_rate") == F.col("cached_rate")
    split = F.col("hit") * F.col("cached_rate") + F.col("miss") * F.col("input_rate")
    whole = F.when(same, F.col("prompt") * F.col("input_rate")).when(F.col("hit") + F.col("miss") == F.col("prompt"), split)
    return rows.withColumn("cost", ((whole + F.col("completion") * F.col("output_rate")) / 1_000_000).cast(MONEY))


def admitted(rows: DataFrame, budget: float, most: int, key: str = "grp", order: str = "id") -> DataFrame:
    """key, order, spent (before the call), reason: null if the call goes out. rows: key, order, cost, reserve (null: no price).

    A call is held if one before it has an unknown cost or cost more than its reserve, if the budget is spent, or if what is spent and the
    call's reserve exceed it, or after ``most`` calls. Once a call is held, all later ones of its key are, for the same reason: so before the first one that is held all
    went out, and what they spent is a running total."""
    known = F.col("cost").isNotNull()
    over = F.col("cost") > F.col("reserve")
    so_far = {"spent": F.coalesce("cost", F.lit(0).cast(MONEY)), "calls": F.lit(1), "unknown": (~known).cast("int"), "exceeded": F.coalesce(over.cast("int"), F.lit(0))}
    run = ordering.running(rows, [order], so_far, (key,))
    late = F.when(F.col("reserve").isNull(), "pricing_model_missing").when(F.col("spent") + F.col("reserve") > budget, "budget_reserve_limit").when(F.col("calls") >= most, "call_limit")
    reason = F.when(F.col("unknown") > 0, "usage_or_cost_unknown").when(F.col("exceeded") > 0, "request_reserve_exceeded").when(F.col("spent") >= budget, "budget_limit").otherwise(late)
    run = run.withColumn("reason", reason)
    first = run.where("reason IS NOT NULL").groupBy(key).agg(F.min(order).alias("_at"), F.min_by("reason", order).alias("_why"))
    return run.join(first, key, "left").select(key, order, F.col("spent").cast(MONEY).alias("spent"), F.when(F.col(order) >= F.col("_at"), F.col("_why")).alias("reason"))
