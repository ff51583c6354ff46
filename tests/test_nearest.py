"""Partners without a cut of tokens' lists: the search against all pairs, and every query that is made from it on the smallest tables."""

import collections
import os
import random

import pyarrow as pa
import pytest

from tallyloom.operators import matching, nearest
from tallyloom.plans import matching_queries, registry, shared, storage_queries
from tallyloom.plans.adapter import Views

DATA = "/root/testdata/sf0.001"


def every_pair(held, who, k):
    """Each item's best by looking at all others."""
    want = {}
    for i in held:
        found = {j: len(held[i] & held[j]) for j in held if j != i and held[i] & held[j]}
        for j in sorted(found, key=lambda j: (-found[j], who[j], j))[:k]:
            want[min(i, j), max(i, j)] = found[j]
    return want


@pytest.mark.parametrize(("block", "small"), [(32_768, 512), (100, 7)])
def test_partners_equal_all_pairs(spark, monkeypatch, block, small):
    """Tokens that nearly all have, that few have, items alike, repeated and null tokens, items without any; in one query block and in several."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "SMALL", small)
    rng = random.Random(11)
    held = {i: {f"t{rng.randrange(40)}" for _ in range(rng.randrange(5))} | ({"all"} if i % 3 else set()) for i in rng.sample(range(-50, 900), 600)}
    who = {i: str(rng.randrange(90)) for i in held}
    items = spark.createDataFrame([(i, who[i], [*ts, *list(ts)[:1], None] if i % 9 else ([*ts] or None)) for i, ts in held.items()], "ordinal long, identity string, tokens array<string>")
    got = nearest.pairs(items, k=3).collect()
    want = every_pair(held, who, 3)
    assert len(got) == len(want) and {(a, b): n for a, b, n in got} == want


def test_an_item_behind_many_holders_is_found(spark):
    """The last two of 400 holders of a token are each other's only good partners."""
    items = spark.createDataFrame([(i, f"A{i:03d}", ["v", *(["w"] if i > 397 else [])]) for i in range(400)], "ordinal long, identity string, tokens array<string>")
    got = {(a, b): n for a, b, n in nearest.pairs(items, k=1).collect()}
    assert got[398, 399] == 2 and (398, 399) not in {(r["a"], r["b"]) for r in matching.recall(items, k=1).collect()}


def test_a_task_keeps_its_own_best_only():
    """Batches of others in any number give the same; of as many shared tokens the smaller numbers stay."""
    rng = random.Random(3)
    sets = [sorted({f"t{rng.randrange(12)}" for _ in range(rng.randrange(1, 6))}) for _ in range(200)]
    rows = [(True, c, sets[c]) for c in range(0, 200, 7)] + [(False, c, sets[c]) for c in range(200)]
    schema = pa.schema([("own", pa.bool_()), ("c", pa.int64()), ("tokens", pa.list_(pa.string()))])
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
    want = {(c, o, n) for c in range(0, 200, 7) for n, o in sorted((-len({*sets[c]} & {*sets[x]}), x) for x in range(200) if {*sets[c]} & {*sets[x]})[:4]}
    want = {(c, o, -n) for c, o, n in want}
    for size in (229, 60, 9):
        got = [tuple(r.values()) for b in nearest._nearest(4)(batch(rows[i : i + size]) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def whole(spark):
    """Products; judgments on all pairs of them by the definition, and by lists of 128."""
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    v = Views(spark, DATA)
    items = matching_queries._items(v).collect()
    pairs = every_pair({r["ordinal"]: set(r["tokens"]) for r in items}, {r["ordinal"]: r["identity"] for r in items}, matching.K)
    edges = matching.judged(spark.createDataFrame([(a, b, n) for (a, b), n in pairs.items()], "a long, b long, score long"))
    return v, shared.cut(edges), shared.cut(matching_queries._edges(v))


def rows(df):
    return collections.Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


QUERIES = ["candidate_labels", "clique_groups", "cluster_replay", "constrained_groups", "group_names", "group_sizes", "positive_components", "recall_coverage", "score_curve", "style_clusters", "weight_replay"]


@pytest.mark.parametrize("name", QUERIES)
def test_queries_look_at_all_holders(whole, monkeypatch, name):
    """As from judgments on all pairs, which lists of 128 don't give."""
    v, edges, lists = whole
    query = lambda: rows(registry.queries()[name](v.spark, DATA))

    def over(some):
        for module in (matching_queries, storage_queries):
            monkeypatch.setattr(module, "_whole", lambda _: some, raising=False)
        return query()

    assert query() == over(edges) != over(lists)


def test_components_of_chains(spark):
    """Long chains and trees with numbers in any order end after few rounds."""
    rng, rounds = random.Random(4), []
    names = rng.sample(range(10_000), 1200)
    edges = [(names[i], names[i + 1]) for i in range(599)] + [(names[i], names[600 + (i - 600) // 3]) for i in range(601, 1200)]
    cut = lambda df: rounds.append(1) or shared.cut(df)
    got = {r["node"]: r["root"] for r in matching.components(spark.createDataFrame(edges, "a long, b long"), cut).collect()}
    assert got == {n: min(names[:600]) for n in names[:600]} | {n: min(names[600:]) for n in names[600:]}
    assert len(rounds) < 40
