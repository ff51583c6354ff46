"""Weekly plan: each region's shops to its machines, most pages first. A shop doesn't go to a machine that had it in one of
the last weeks (the oldest bar is dropped first if none is left, none holds for a shop that was away); of the others it
goes to the one with the least load of the balance window and this week together, then of this week, then the first.

Where a shop may go follows from its last weeks alone, so that is worked out for all shops at once, as columns; so is the load that
machines come with. Only the choice among these depends on the shops before, so a region (some dozen shops) is one group for it."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "region long, shop long, pages long, machine string, eligible int, relaxed int"


def places(recent: Column, machines: list[str]) -> Column:
    """(open, relaxed) of a shop that was at these machines in the last weeks, the newest first, null where it was away: the numbers of the machines that
    it may go to, and how many bars were dropped for it."""
    away = F.array_position(F.transform(recent, lambda m: m.isNull()), True)
    bars = F.when(away > 0, F.slice(recent, 1, F.greatest(away - 1, F.lit(0)).cast("int"))).otherwise(recent)
    all_ = F.array(*map(F.lit, machines))
    free = F.transform(F.sequence(F.lit(0), F.size(bars)), lambda k: F.array_except(all_, F.slice(bars, F.lit(1), k)))
    kept = F.array_max(F.transform(free, lambda some, k: F.when(F.size(some) > 0, k)))
    return F.struct(F.transform(F.get(free, kept), lambda m: (F.array_position(all_, m) - 1).cast("int")).alias("open"), (F.size(bars) - kept).cast("int").alias("relaxed"))


def fill(pages: list[int], open_: list[list[int]], load: list[int]) -> list[int]:
    """The machine's number for each shop in turn, given what machines carry already."""
    carried, fresh, out = np.array(load, float), np.zeros(len(load)), []
    for n, some in zip(pages, open_, strict=True):
        some = np.sort(np.asarray(some, int))
        order = np.lexsort((some, fresh[some], (carried + fresh)[some]))
        out.append(int(some[order[0]]))
        fresh[out[-1]] += n
    return out


def assign(shops: list[tuple[int, int]], machines: list[str], history: dict[int, dict[int, tuple[str, int]]], week: int, barred: int = 1, balance: int = 4) -> list[tuple[int, int, str, int, int]]:
    """One region without Spark: (shop, pages, machine, eligible, relaxed). shops: (shop, pages); history: week -> shop -> (machine,
    pages then)."""
    weeks = sorted((w for w in history if w < week), reverse=True)
    turns = sorted((-pages, shop) for shop, pages in shops if pages > 0)
    open_, relaxed = [], []
    for _, shop in turns:
        bars = [m for m, _ in itertools.takewhile(bool, (history[w].get(shop) for w in weeks[:barred]))]
        free = [[i for i, m in enumerate(machines) if m not in bars[:k]] for k in range(len(bars) + 1)]
        kept = max(k for k, some in enumerate(free) if some)
        open_.append(free[kept])
        relaxed.append(len(bars) - kept)
    load = [sum(n for w in weeks[: balance - 1] for m, n in history[w].values() if m == name) for name in machines]
    chosen = fill([-n for n, _ in turns], open_, load)
    return [(shop, -n, machines[i], len(some), gone) for (n, shop), i, some, gone in zip(turns, chosen, open_, relaxed, strict=True)]


def weekly_plan(shops: DataFrame, history: DataFrame, machines: list[str], week: int, barred: int = 1, balance: int = 4) -> DataFrame:
    """shops: region, shop, pages; history: region, week, shop, pages, machine."""
    past = history.where(F.col("week") < week).withColumn("ago", F.dense_rank().over(Window.partitionBy("region").orderBy(F.desc("week"))))
    last = past.where(F.col("ago") <= barred).groupBy("region", "shop").agg(F.map_from_entries(F.collect_list(F.struct("ago", "machine"))).alias("at"))
    weeks = past.groupBy("region").agg(F.least(F.max("ago"), F.lit(barred)).alias("weeks"))
    load = past.where(F.col("ago") < balance).groupBy("region").agg(F.array(*(F.sum(F.when(F.col("machine") == m, F.col("pages")).otherwise(0)) for m in machines)).alias("load"))
    recent = F.when(F.col("weeks") > 0, F.transform(F.sequence(F.lit(1), F.col("weeks")), lambda k: F.try_element_at("at", k))).otherwise(F.array().cast("array<string>"))
    turns = shops.where("pages > 0").join(last, ["region", "shop"], "left").join(weeks, "region", "left").join(load, "region", "left")
    turns = turns.select("region", "shop", "pages", places(recent, machines).alias("to"), F.coalesce("load", F.array(*[F.lit(0).cast("long")] * len(machines))).alias("load"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pages", "shop"], ascending=[False, True])
        chosen = fill(rows["pages"].tolist(), rows["open"].tolist(), rows["load"].iloc[0])
        return pd.DataFrame({"region": key[0], "shop": rows["shop"], "pages": rows["pages"], "machine": [machines[i] for i in chosen], "eligible": rows["open"].map(len), "relaxed": rows["relaxed"]})

    return turns.select("region", "shop", "pages", "to.open", "to.relaxed", "load").groupBy("region").applyInPandas(run, SCHEMA)
