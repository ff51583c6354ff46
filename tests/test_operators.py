"""Hand-computed cases of the stock series, matching, text and package operators."""

import collections
import itertools
import random
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text
from tallyloom.operators import matching, planning, series
from tallyloom.sources import packages

SEPT = "2026-09-{:02d}".format


def inventory(spark, cases):
    rows = [("A", offer, sku, SEPT(d), s) for offer, skus in cases.items() for sku, days in skus.items() for d, s in days.items()]
    return spark.createDataFrame(rows, "shop string, offer string, sku string, date string, stock long").withColumn("date", F.col("date").cast("date"))


def run(spark, cases, low, high):
    rows = series.sku_series(inventory(spark, cases), SEPT(low), SEPT(high)).collect()
    return {(r["offer"], r["sku"], r["date"].day): r for r in rows}, sum(r["sales"] for r in rows)


def test_new_sku_and_gap(spark):
    got, sales = run(spark, {"o": {"a": {7: 100, 9: 90}, "b": {10: 50, 14: 40}}}, 7, 14)
    assert sales == 20 and ("o", "b", 7) not in got and got["o", "b", 10]["sales"] == 0
    assert got["o", "a", 8]["color"] == "yellow" and got["o", "a", 14]["stock"] + got["o", "b", 14]["stock"] == 130


def test_shape_flip(spark):
    got, sales = run(spark, {"o": {"default": {7: 100, 8: 90}, "white": {10: 40, 14: 30}, "cream": {10: 60, 14: 50}}}, 7, 14)
    assert sales == 30 and ("o", "default", 10) not in got
    assert got["o", "white", 10]["stock"] + got["o", "cream", 10]["stock"] == 100


def test_flip_back(spark):
    got, sales = run(spark, {"o": {"default": {7: 100, 8: 90, 15: 20, 16: 0}, "white": {10: 40, 14: 30}, "cream": {10: 60, 14: 50}}}, 7, 16)
    assert sales == 50 and got["o", "default", 16]["stock"] == 0 and got["o", "default", 15]["sales"] == 0


def test_baselines(spark):
    got, sales = run(spark, {"P": {"down": {6: 120, 7: 100, 14: 80}, "restock": {7: 50, 8: 90}}}, 7, 14)
    assert sales == 20 and got["P", "down", 7]["sales"] == 0
    assert (got["P", "down", 8]["stock"], got["P", "down", 8]["color"]) == (100, "yellow") and got["P", "down", 14]["sales"] == 20
    assert got["P", "restock", 8]["color"] == "red" and got["P", "restock", 8]["sales"] == 0


def test_sum_of_skus(spark):
    rows = series.sku_series(inventory(spark, {"o": {"a": {7: 100, 8: 80}, "b": {7: 50, 8: 90}}}), SEPT(7), SEPT(8))
    up = {r["date"].day: r for r in series.roll_up(rows, "shop", "offer").collect()}
    assert up[8]["sales"] == 20 and up[8]["color"] == "red" and up[8]["stock"] == 170


def test_recall_scores_and_cap(spark):
    items = spark.createDataFrame([(0, "A0", ["a", "b", "c"]), (1, "A1", ["a", "b"]), (2, "A2", ["c"])], "ordinal long, identity string, tokens array<string>")
    assert {tuple(r) for r in matching.recall(items).collect()} == {(0, 1, 2), (0, 2, 1)}
    many = spark.createDataFrame([(i, f"A{i:03d}", ["v"]) for i in range(130)], "ordinal long, identity string, tokens array<string>")
    got = {(r["a"], r["b"]): r["score"] for r in matching.recall(many).collect()}
    assert got[0, 129] == 0 and got[0, 1] == 1  # the last item finds others, but no list holds it
    back = many.withColumn("identity", F.concat(F.lit("B"), F.lpad((F.lit(500) - F.col("ordinal")).cast("string"), 3, "0")))
    assert (0, 127) in {(r["a"], r["b"]) for r in matching.recall(back).collect()}  # ties go by identity, not by place



@pytest.mark.parametrize("most", [0, matching.LISTED])
def test_recall_equals_all_pairs_of_lists(spark, most):
    """By lists that go to every task, and by lists dealt by token."""
    rng = random.Random(11)
    held = {i: {f"t{rng.randrange(40)}" for _ in range(rng.randrange(9))} | {"all"} for i in rng.sample(range(-50, 900), 400)}
    who = {i: str(rng.randrange(90)) for i in held}
    lists = {t: set(sorted(i for i in held if t in held[i])[:5]) for t in set().union(*held.values())}
    score = lambda a, b: sum(b in lists[t] for t in held[a])
    want = {}
    for i in held:
        for j in sorted((j for j in held if j != i and score(i, j)), key=lambda j: (-score(i, j), who[j], j))[:3]:
            want[min(i, j), max(i, j)] = score(min(i, j), max(i, j))
    items = spark.createDataFrame([(i, who[i], [*ts, "all"]) for i, ts in held.items()], "ordinal long, identity string, tokens array<string>")
    got = matching.recall(items, posting=5, k=3, most=most).collect()
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_recall_does_not_move_items(spark):
    """What is shuffled follows the lists: of many items, no exchange takes all."""
    items = spark.range(20_000).selectExpr("id AS ordinal", "CAST(id AS STRING) AS identity", "array('all', concat('m', id % 7)) AS tokens")
    pairs = matching.recall(items)
    assert pairs.count() == pairs.distinct().count() > 20_000
    others = pairs._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "MapInArrow" in others and not any(x in others for x in ("Join", "Aggregate", "Window", "Repartition"))


def test_name_tokens_clean_a_name_once(spark):
    """By hand, with characters beyond 16 bits and names that are too short; recall works them out once a row, for names and for rows alike."""
    names = ["Ab-Ab c9", "x", "", None, "\U00020000\U00020001 a", "\u00c4\u00d6 \u0130z", "a\u2028b\n\u0663"]
    rows = spark.createDataFrame([(i, str(i), n) for i, n in enumerate(names)], "ordinal long, identity string, name string")
    got = {r[0]: r[1] for r in rows.select("ordinal", matching.name_tokens(F.col("name"))).collect()}
    for i, n in enumerate(names):
        bare = "".join(c for c in n or "" if c.isalnum()).lower()
        assert got[i] == list(dict.fromkeys("t:" + bare[j : j + 2] for j in range(len(bare) - 1)))
    pairs = matching.recall(rows.withColumn("tokens", matching.name_tokens(F.col("name"))))
    assert pairs._jdf.queryExecution().optimizedPlan().children().head().toString().count("regexp_replace") == 1


def test_recall_counts_rows_alike_once(monkeypatch):
    """Rows with the same tokens that lie together are counted once, and each gets its own pairs: none with itself, k at most."""
    calls, often = [], matching._often
    monkeypatch.setattr(matching, "_often", lambda numbers, k: calls.append(k) or often(numbers, k))
    # token a lists items 0 to 3 (ordinals 10 to 13), token b item 3
    lists = types.SimpleNamespace(value=(pa.array(["a", "b"]), np.array([0, 4, 5]), np.array([0, 1, 2, 3, 3], np.int32), np.arange(10, 14)))
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.list_(pa.string()))], names=["ordinal", "tokens"])
    found = lambda rows, listed: [tuple(r.values()) for b in matching._found(lists, 2, listed)(iter([batch(rows[:3]), batch(rows[3:])])) for r in b.to_pylist()]
    rows = [(10, ["a"]), (11, ["a"]), (20, ["a", "b"]), (21, ["a", "b"]), (22, ["none"]), (13, ["a"])]
    assert found(rows, True) == [(10, 11, 1), (10, 12, 1), (11, 10, 1), (11, 12, 1), (20, 13, 2), (20, 10, 1), (21, 13, 2), (21, 10, 1), (13, 10, 1), (13, 11, 1)]
    assert len(calls) == 4
    calls.clear()
    assert found(rows, False) == [(20, 13, 2), (20, 10, 1), (21, 13, 2), (21, 10, 1)] and len(calls) == 2


def test_most_frequent_numbers():
    rng = np.random.default_rng(5)
    for _ in range(300):
        numbers = rng.integers(0, rng.integers(1, 200), rng.integers(0, 300)).astype(rng.choice([np.int32, np.int64]))
        k = int(rng.integers(1, 9))
        want = sorted(collections.Counter(numbers.tolist()).items(), key=lambda x: (-x[1], x[0]))[:k]
        assert list(zip(*(x.tolist() for x in matching._often(numbers, k)), strict=True)) == want


def merged(nodes, positive, negative, weight=2.0):
    """Every item its own version."""
    return matching.greedy({n: str(n) for n in nodes}, [(str(a), str(b), s) for s, es in ((True, positive), (False, negative)) for a, b in es], weight=weight)


def rescanned(versions, edges, excluded, weight):
    """The clustering's rule by looking at all pairs of clusters at each step."""
    group = {i: i for i in versions}
    judged = {(frozenset((a, b)), s) for a, b, s in edges}
    while True:
        best = None
        for x, y in itertools.combinations(sorted(set(group.values())), 2):
            left, right = ([i for i in versions if group[i] == c] for c in (x, y))
            good, bad = (sum((frozenset((versions[i], versions[j])), s) in judged for i in left for j in right) for s in (True, False))
            across = any({group[a], group[b]} == {x, y} for a, b in excluded if a in group and b in group)
            if good - weight * bad > 0 and not across and (best is None or (weight * bad - good, x, y) < best):
                best = (weight * bad - good, x, y)
        if best is None:
            return group
        group = {i: best[1] if c == best[2] else c for i, c in group.items()}


def test_constrained_clusters_equal_rescanning(spark):
    """Versions that items share, judgments of a version with itself, excluded pairs, frozen groups; in one go and by
    components on Spark."""
    rng = random.Random(8)
    every, number = [], 0
    for trial in range(40):
        versions = {number + i: f"{trial}:{rng.randrange(5)}" for i in range(9)}
        names = sorted(set(versions.values()))
        edges = [(a, b, rng.random() < 0.6) for a, b in itertools.combinations_with_replacement(names, 2) if rng.random() < 0.6]
        excluded = [tuple(rng.sample(sorted(versions), 2)) for _ in range(3)] + [(number, 10**6)]
        frozen = rng.sample(sorted(versions), 2) if trial % 2 else []
        live = {i: v for i, v in versions.items() if i not in frozen}
        want = rescanned(live, edges, excluded, 2.0)
        assert matching.greedy(live, edges, excluded) == want
        every.append((versions, edges, excluded, frozen, want | {i: min(frozen) for i in frozen}))
        number += 9
    items = spark.createDataFrame([r for v, *_ in every for r in v.items()], "ordinal long, version string")
    edges = spark.createDataFrame([e for _, es, *_ in every for e in es], "va string, vb string, positive boolean")
    excluded = spark.createDataFrame([p for _, _, ps, *_ in every for p in ps], "a long, b long")
    frozen = spark.createDataFrame([(i, f"G{k}") for k, x in enumerate(every) for i in x[3]] + [(10**7, "G1")], "ordinal long, group string")
    cut = lambda d: d.checkpoint()
    placed = matching.assemble(items, edges, cut, frozen, excluded)
    assert {r[0]: r[1] for r in placed.collect()} == {i: c for x in every for i, c in x[4].items()}
    groups = frozen.select(F.col("group").alias("group_id"), "ordinal").union(spark.createDataFrame([("M1", 10**8)], "g string, o long"))
    names = {r["cluster"]: r["group_id"] for r in matching.named(placed, groups.where("ordinal < 10000000"), cut).collect()}
    assert len(set(names.values())) == len(names) and all(names[min(x[3])] == f"G{k}" for k, x in enumerate(every) if x[3])


@pytest.mark.parametrize(
    "positive, negative, weight, want",
    [
        ({(1, 4), (1, 5), (1, 6)}, set(), 2, [{1, 4, 5, 6}, {2}, {3}]),
        ({(1, 2), (1, 3)}, {(2, 3)}, 2, [{1, 2}, {3}]),
        ({(1, 2), (2, 3)}, {(1, 3)}, 0, [{1, 2, 3}]),
        ({(1, 2), (2, 3)}, {(1, 3)}, 2, [{1, 2}, {3}]),
        ({(1, 2), (1, 3), (2, 3), (3, 4)}, {(1, 4), (2, 4)}, 10**6, [{1, 2, 3}, {4}]),
    ],
)
def test_greedy_clusters(spark, positive, negative, weight, want):
    nodes = sorted({*itertools.chain(*want)})
    found = merged(nodes, positive, negative, weight)
    groups = lambda f: sorted(sorted(n for n in nodes if f[n] == c) for c in set(f.values()))
    assert groups(found) == sorted(map(sorted, want))
    edges = spark.createDataFrame([(*e, s) for s, es in ((True, positive), (False, negative)) for e in es], "a long, b long, positive boolean")
    items = spark.createDataFrame([(n,) for n in nodes], "ordinal long")
    out = {r["ordinal"]: r["cluster"] for r in matching.clusters(items, edges, lambda d: d.checkpoint(), weight).collect()}
    assert groups(out) == groups(found)


def test_components_law():
    """Merging by components of positive edges equals merging all at once."""
    rng = random.Random(5)
    for _ in range(60):
        nodes = list(range(8))
        edges = [e for e in itertools.combinations(nodes, 2) if rng.random() < 0.5]
        positive = {e for e in edges if rng.random() < 0.4}
        negative = set(edges) - positive
        whole = merged(nodes, positive, negative)
        root = merged(nodes, positive, set(), 0)
        apart = {}
        for c in set(root.values()):
            inside = [n for n in nodes if root[n] == c]
            keep = lambda es, c=c: {e for e in es if root[e[0]] == root[e[1]] == c}
            apart |= merged(inside, keep(positive), keep(negative))
        assert whole == apart


@pytest.mark.parametrize("raw, price, stock", [("1,234.5", 1234.5, 1234), ("-3 5", 5.0, 5), ("64.8万", 64.8, 648_000), ("2亿", 2.0, 200_000_000), ("x", None, None), ("a 7件", 7.0, 7), (None, None, None)])
def test_amounts(spark, raw, price, stock):
    df = spark.createDataFrame([(raw,)], "t string")
    assert tuple(df.select(text.price(F.col("t")), text.stock(F.col("t"))).first()) == (price, stock)


@pytest.mark.parametrize("raw, want", [("# ab-1 #", ["AB-1"]), ("#Q# #Z#", ["Q", "Z"]), ("＃a＃", ["A"]), ("none", []), ("##", [])])
def test_codes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.codes(F.col("t"))).first()[0] == want


def test_redaction(spark):
    raw = "api_key = abc # note\npassword_env = KEEP\nname: x\ntoken: \"a # b\"  # why\nsecret=z"
    got = spark.createDataFrame([(raw,)], "t string").select(text.redact(F.col("t"))).first()[0]
    assert got.splitlines() == ["api_key = *** # note", "password_env = KEEP", "name: x", "token: ***  # why", "secret=***"]


def test_package_reads(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    df = spark.createDataFrame([(1, 9), (2, 8)], "a long, extra long")
    packages.write_package({"t": df.selectExpr("*", "'m1' AS machine")}, str(tmp_path))
    assert sorted(map(tuple, packages.table_or_empty(spark, f"{tmp_path}/t", schema).collect())) == [(1, None), (2, None)]
    assert packages.table_or_empty(spark, f"{tmp_path}/none", schema).count() == 0
    one, two = packages.digest(df).first(), packages.digest(df.repartition(5).orderBy(F.desc("a"))).first()
    assert one == two and packages.digest(df.limit(1)).first() != one


def test_weekly_plan(spark):
    shops, machines = [(1, 10), (2, 9), (3, 8), (4, 7), (5, 0)], ["m1", "m2", "m3"]
    assert planning.assign(shops, machines, {}, 1) == [(1, 10, "m1", 3, 0), (2, 9, "m2", 3, 0), (3, 8, "m3", 3, 0), (4, 7, "m3", 3, 0)]
    past = {1: {1: ("m1", 10), 2: ("m2", 9), 3: ("m3", 8)}}
    assert planning.assign(shops, machines, past, 2) == [(1, 10, "m3", 2, 0), (2, 9, "m1", 2, 0), (3, 8, "m2", 2, 0), (4, 7, "m2", 3, 0)]
    assert planning.assign([(1, 10)], ["m1"], past, 2) == [(1, 10, "m1", 1, 1)]  # the bar gives way
    two = {1: {1: ("m1", 1)}, 2: {1: ("m2", 1)}, 3: {2: ("m1", 5)}}
    assert planning.assign([(1, 10)], ["m1", "m2"], two, 4)[0][3:] == (2, 0)  # away last week: no bar
    assert planning.assign([(1, 10)], ["m1", "m2"], {w: two[w] for w in (1, 2)}, 3, barred=2)[0] == (1, 10, "m1", 1, 1)  # the oldest bar goes first
    rng = random.Random(3)
    history = [(r, w, i, rng.randrange(1, 25), f"m{rng.randrange(3) + 1}") for r in (1, 2) for w in (1, 2, 3) for i in range(12)]
    df = spark.createDataFrame(history, "region long, week long, shop long, pages long, machine string")
    now = df.where("week = 3").select("region", "shop", "pages")
    rows = planning.weekly_plan(now, df, machines, 4).collect()
    last = {(r, i): m for r, w, i, _, m in history if w == 3}
    assert len(rows) == 24 and all(r["machine"] != last[r["region"], r["shop"]] and r["relaxed"] == 0 for r in rows)