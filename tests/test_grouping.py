"""Code grouping against a member-by-member version on random cases, all in one job."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import grouping
from tallyloom.plans import shared


def one_by_one(members, anchors, closed, pairs):
    """members: (m, code) in order; anchors: group -> members; pairs: frozensets."""
    code = dict(members)
    codes = {g: {code[m] for m in ms} - {None} for g, ms in anchors.items()}
    held, out, newest = {g: list(ms) for g, ms in anchors.items()}, {}, {}
    for m, c in members:
        if any(m in ms for ms in anchors.values()):
            continue
        if c is None:
            out[m] = ("unjudged", -1 - m)
            continue
        good = [g for g in anchors if g not in closed and c in codes[g] and not any(frozenset((m, o)) in pairs for o in held[g])]
        if len(good) == 1:
            held[good[0]].append(m)
            out[m] = ("code_rule", good[0])
        elif good:
            out[m] = ("pending_candidates", -1 - m)
        else:
            if c not in newest or any(frozenset((m, o)) in pairs for o in newest[c]):
                newest[c] = []
            newest[c].append(m)
            out[m] = ("code_rule", -1 - newest[c][0])
    return out


def test_codes_equal_one_by_one(spark):
    rng = random.Random(7)
    members, anchored, pairs, want = [], [], [], {}
    for case in range(1000):
        base = case * 100
        n = rng.randrange(2, 16)
        own = [(base + i, rng.choice([None, "A", "A", "B", "C"][: rng.randrange(1, 6)])) for i in range(n)]
        groups, closed = {}, set()
        for g in range(rng.randrange(0, 4)):
            free = [m for m, _ in own if all(m not in ms for ms in groups.values())]
            if ms := rng.sample(free, min(len(free), rng.randrange(0, 3))):
                groups[base + 50 + g] = ms
                if rng.random() < 0.2:
                    closed.add(base + 50 + g)
        cuts = {frozenset(rng.sample([m for m, _ in own], 2)) for _ in range(rng.choice([0, 2, 8, 30]))} if n > 2 else set()
        want |= one_by_one(own, groups, closed, cuts)
        members += [(m, c and f"{c}{case}") for m, c in own]
        anchored += [(m, g, g in closed) for g, ms in groups.items() for m in ms]
        pairs += [tuple(rng.sample(sorted(p), 2)) for p in cuts]
    args = spark.createDataFrame(members, "m long, code string"), spark.createDataFrame(anchored, "m long, grp long, closed boolean"), spark.createDataFrame(pairs + pairs[:5] + [(3, 3)], "a long, b long")
    got = {r["m"]: (r["state"], r["grp"]) for r in grouping.place_by_codes(*args, shared.cut).collect()}
    assert got == want
    assert grouping.place_by_codes(args[0].limit(0), args[1].limit(0), args[2].limit(0), shared.cut).count() == 0


def test_a_hot_code_takes_few_rounds(spark):
    """Twenty thousand members of one code, each excluded with the one before: as many runs, by doubling."""
    members = spark.range(20_000).select(F.col("id").alias("m"), F.lit("A").alias("code"))
    pairs = members.where("m > 0").select((F.col("m") - 1).alias("a"), F.col("m").alias("b"))
    none = spark.createDataFrame([], "m long, grp long, closed boolean")
    got = grouping.place_by_codes(members, none, pairs, shared.cut)
    assert got.where("grp = -1 - m").count() == 20_000


def test_legal_groups(spark):
    members = spark.createDataFrame([(1, "A", False, True), (2, "A", False, False), (3, None, False, True), (4, "B", True, False), (5, None, False, False), (6, "A", False, True), (7, None, False, True)], "m long, code string, waits boolean, alone boolean")
    groups = spark.createDataFrame([(2, 10, True, False), (4, 20, False, False), (5, 30, True, False)], "m long, grp long, human boolean, closed boolean")
    pairs, out = spark.createDataFrame([(6, 2), (3, 5), (3, 4)], "a long, b long"), spark.createDataFrame([(7,)], "m long")
    got = sorted(map(tuple, grouping.legal_groups(members, groups, pairs, out).collect()), key=str)
    assert got == [(1, 10), (3, -30), (3, None)]


def test_legal_counts_equal_legal_groups(spark):
    rng = random.Random(3)
    members = [(m, rng.choice([None, "A", "B", "C"]), rng.random() < 0.2, m % 3 > 0) for m in range(300)]
    groups = [(m, m if m % 3 else m // 9, m % 6 == 0, m % 18 == 0) for m, *_ in members]
    args = (
        spark.createDataFrame(members, "m long, code string, waits boolean, alone boolean").withColumn("waits", F.expr("waits AND code IS NOT NULL AND NOT alone")),
        spark.createDataFrame(groups, "m long, grp long, human boolean, closed boolean"),
        spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(2000)], "a long, b long"), spark.createDataFrame([(m,) for m in range(0, 300, 23)], "m long"),
    )
    groups_, waiting = args[1], args[0].where("waits").join(args[1], "m").select("grp")
    fit = groups_.groupBy("grp").agg(F.max("closed").alias("c")).where("NOT c").join(groups_.join(args[3], "m").select("grp"), "grp", "left_anti").join(waiting, "grp", "left_anti").count()
    want = {}
    for m, grp in grouping.legal_groups(*args).collect():
        want[m] = want.get(m, 0) + (fit - 1 if grp is None else 1 if members[m][1] else -1)
    assert {m: n for m, n in grouping.legal_counts(*args).collect() if n} == {m: n for m, n in want.items() if n}


def test_a_hot_code_makes_no_pairs(spark):
    """Forty thousand members and twenty thousand groups of one code: eight hundred million pairs."""
    every = spark.range(60_000).select(F.col("id").alias("m"))
    members = every.select("m", F.lit("A").alias("code"), F.lit(False).alias("waits"), (F.col("m") < 40_000).alias("alone"))
    groups = every.select("m", F.col("m").alias("grp"), (F.col("m") >= 40_000).alias("human"), F.lit(False).alias("closed"))
    got = grouping.legal_counts(members, groups, spark.createDataFrame([(7, 50_000)], "a long, b long"), every.limit(0))
    assert sorted(map(tuple, got.groupBy("n").count().collect())) == [(19_999, 1), (20_000, 39_999)]
