"""Steps behind recall move only what their result depends on: most judgments are negative and lie in no component of positive ones."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import matching
from tallyloom.plans import decisions, matching_queries, shared
from tallyloom.plans.adapter import Views

ITEMS = 60
GOOD = [(1, 2), (2, 3), (4, 5)]
BAD = [p for p in itertools.combinations(range(ITEMS), 2) if p not in GOOD][:900]
DATA = "/root/testdata/sf0.01"


@pytest.fixture()
def kept():
    """A cut that writes down how many rows it keeps."""
    rows = []

    def cut(df):
        df = df.checkpoint()
        rows.append(df.count())
        return df

    cut.rows = rows
    return cut


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame([(*p, True) for p in GOOD] + [(*p, False) for p in BAD], "a long, b long, positive boolean")
    return spark.createDataFrame([(i,) for i in range(ITEMS)], "ordinal long"), edges


def test_clusters_keep_judgments_inside_components_only(graph, kept):
    items, edges = graph
    got = {r["ordinal"]: r["cluster"] for r in matching.clusters(items, edges, kept).collect()}
    # 1 and 3 are judged apart: weight 2 lets 1 and 2 merge, but not 3
    assert got == {i: {2: 1, 5: 4}.get(i, i) for i in range(ITEMS)}
    assert max(kept.rows) < 20


def test_weights_share_components(graph, kept, monkeypatch):
    items, edges = graph
    calls, components = [], matching.components
    monkeypatch.setattr(matching, "components", lambda *x: calls.append(1) or components(*x))
    got = {r["weight"]: tuple(r)[1:] for r in matching.replays(items, edges, [0.0, 2.0], kept).collect()}
    # weight 0: 1, 2, 3 and 4, 5 with one negative edge inside
    assert got == {0.0: (ITEMS - 3, 1.0, 0.75), 2.0: (ITEMS - 2, 0.666667, 1.0)}
    assert len(calls) == 1 and max(kept.rows) < 20


def test_replay_keeps_edges_among_merged_items_only(graph, kept, spark):
    items, edges = graph
    placed = items.withColumn("cluster", F.when(F.col("ordinal").isin(2, 3), 1).otherwise(F.col("ordinal")))
    assert tuple(matching.replay(edges, placed, kept).first()) == (ITEMS - 2, 0.666667, 0.666667)
    assert max(kept.rows) < 20
    none = edges.where("false")
    assert tuple(matching.replay(none, placed, kept).first()) == (ITEMS - 2, None, None)
    assert tuple(matching.replay(edges, items.withColumn("cluster", F.col("ordinal")), kept).first()) == (ITEMS, 0.0, None)


def test_candidates_keep_positive_edges_only(graph, kept):
    items, edges = graph
    placed = items.withColumn("cluster", F.when(F.col("ordinal") == 2, 1).otherwise(F.col("ordinal")))
    got = {r["ordinal"]: (r["n_groups"], r["label"]) for r in matching.candidates(edges, placed, kept).collect()}
    assert got == {i: (1, "unique") if i in (2, 3, 4, 5) else (0, "none") for i in range(ITEMS)}
    assert max(kept.rows) < 20


def test_clique_groups_keep_items_with_judgments_only(graph, kept, spark):
    items, edges = graph
    links = edges.where("positive").select(F.col("a").cast("string").alias("va"), F.col("b").cast("string").alias("vb"))
    got = {r[0]: r[1] for r in matching.clique_groups(items.withColumn("version", F.col("ordinal").cast("string")), links, kept).collect()}
    assert got == {i: {2: 1, 5: 4}.get(i, i) for i in range(ITEMS)}
    assert max(kept.rows) < 20


def test_many_rows_are_not_sent_to_every_task(graph, monkeypatch):
    """Past the bound joins shuffle, with the same clusters."""
    items, edges = graph
    cut = lambda d: d.checkpoint()
    hinted = lambda: shared.few(items, cut)._jdf.queryExecution().analyzed().toString().count("ResolvedHint")
    assert hinted() == 1
    monkeypatch.setattr(shared, "FEW", 0)
    assert hinted() == 0
    got = {r["ordinal"]: r["cluster"] for r in matching.clusters(items, edges, cut).collect()}
    assert got == {i: {2: 1, 5: 4}.get(i, i) for i in range(ITEMS)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_picture_placement_turns_few_judgments(spark, monkeypatch):
    """As by looking at all judgments both ways; what it joins with the groups are those of items with a positive one."""
    v, sizes, few = Views(spark, DATA), [], shared.few
    edges = shared.cut(matching_queries._edges(v))
    # judgments with more positive ones than names give, so that some are placed, some wait, and some are kept out by negative ones
    edges = shared.cut(edges.withColumn("positive", F.pmod(F.col("a") * 7 + F.col("b"), F.lit(23)) == 0))
    monkeypatch.setattr(matching_queries, "_edges", lambda _: edges)
    monkeypatch.setattr(decisions, "few", lambda df: sizes.append((df := few(df)).count()) or df)
    got = {r["ordinal"]: (r["state"], r["grp"]) for r in decisions.picture_placement(v).collect()}
    of = {r["ordinal"]: (r["state"], r["root"]) for r in decisions.replay(v).collect()}
    judged = {}
    for a, b, good in edges.select("a", "b", "positive").collect():
        for x, y in ((a, b), (b, a)):
            if of[x][0] == "open" and of[y][0] == "confirmed":
                judged.setdefault(x, {}).setdefault(of[y][1], []).append(good)
    want = {}
    for x, (state, _) in of.items():
        if state == "open":
            fit = [g for g, some in judged.get(x, {}).items() if all(some)]
            want[x] = ("placed", fit[0]) if len(fit) == 1 else ("pending" if fit else "alone", None)
    assert got == want and {s for s, _ in want.values()} >= {"placed", "alone"}
    assert max(sizes) < edges.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_near_judgments_are_those_of_versions_with_a_positive_one(spark, monkeypatch):
    v = Views(spark, DATA)
    edges = shared.cut(matching_queries._edges(v).withColumn("positive", F.pmod(F.col("a") * 7 + F.col("b"), F.lit(211)) == 0))
    monkeypatch.setattr(matching_queries, "_edges", lambda _: edges)
    every = matching_queries._judgments(v).groupBy(F.least("va", "vb"), F.greatest("va", "vb")).agg(F.max("positive")).collect()
    ends = {x for r in every if r[2] for x in r[:2]}
    got = set(map(tuple, matching_queries._near(v).collect()))
    assert got == {tuple(r) for r in every if r[0] in ends and r[1] in ends} and 0 < len(got) < len(every)
