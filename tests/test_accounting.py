"""Numbering in any order of packages, budgets against a loop, running totals over keys and ranges."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyloom.operators import budget, ordering, surrogates
from tallyloom.sources import snapshots


def test_same_numbers_in_any_order(spark):
    rounds = [("m2", 5, "x"), ("m1", 9, "x"), ("m1", 2, "y"), ("m1", 2, "y"), ("m1", 3, "a"), ("m1", 3, "b")]
    shops = [("m1", 1, 9), ("m1", 2, 3), ("m2", 1, 5), ("m2", 7, 99), ("m1", 4, None)]

    def run(turn):
        levels = [surrogates.Level("r", spark.createDataFrame(rounds[::turn], "machine string, id long, content string")), surrogates.Level("s", spark.createDataFrame(shops[::turn], "machine string, id long, r long"), "r")]
        return sorted(map(tuple, surrogates.remap(levels).collect()), key=str)

    assert run(1) == run(-1) == sorted(
        [("r", "m1", 2, 1, None, None), ("r", "m1", 9, 2, None, None), ("r", "m2", 5, 3, None, None), ("r", "m1", 3, None, None, "two contents"), ("s", "m1", 1, 1, 2, None), ("s", "m2", 1, 2, 3, None)]
        + [("s", "m1", 2, None, None, "orphan"), ("s", "m2", 7, None, None, "orphan"), ("s", "m1", 4, None, None, "orphan")], key=str)


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(5)
    got = {r["i"]: (r["s"], r["c"]) for r in ordering.running(df, ["i"], {"s": F.col("n"), "c": F.lit(1)}, ("k",)).collect()}
    total = {"a": (0, 0), "b": (0, 0)}
    for k, i, n in rows:
        assert got[i] == total[k]
        total[k] = total[k][0] + n, total[k][1] + 1
    assert sorted(r["rn"] for r in ordering.numbered(df, "n", "i").collect()) == list(range(1, 3001))
    assert ordering.numbered(df.limit(0), "n").count() == 0


def test_budgets_equal_a_loop(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for key in range(60):
        spent, calls, why, unknown, over = Decimal(0), 0, None, False, False
        for i in range(rng.randrange(1, 40)):
            cost = None if rng.random() < 0.01 else Decimal(rng.randrange(1, 110)) / 1000
            reserve = None if rng.random() < 0.02 else Decimal("0.108")
            if key == 7:  # spends the budget to the last
                cost = reserve = Decimal("0.25")
            rows.append((key, 100 * key + i, cost, reserve))
            if why is None:
                if unknown:
                    why = "usage_or_cost_unknown"
                elif over:
                    why = "request_reserve_exceeded"
                elif spent >= 1:
                    why = "budget_limit"
                elif reserve is None:
                    why = "pricing_model_missing"
                elif spent + reserve > 1:
                    why = "budget_reserve_limit"
                elif calls >= 20:
                    why = "call_limit"
            want[100 * key + i] = why
            spent, calls, unknown, over = spent + (cost or 0), calls + 1, unknown or cost is None, over or (cost is not None and reserve is not None and cost > reserve)
    df = spark.createDataFrame(rows, "grp long, id long, cost decimal(28,12), reserve decimal(12,4)").repartition(4)
    assert {r["id"]: r["reason"] for r in budget.admitted(df, 1.0, 20).collect()} == want
    assert len(set(want.values())) == 7


def test_pins_hold(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    pin = snapshots.Pinned(spark, str(tmp_path), ["t"])
    first = pin.read("t")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t")
    assert first.count() == pin.read("t").count() == 10 and spark.read.parquet(f"{tmp_path}/t").count() == 15
