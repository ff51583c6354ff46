"""What the stage near_duplicates keeps, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import common, jaccard, simhash

SF = "/root/testdata/sf0.01"


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def alike_pairs(sets, least=0.8):
    """All pairs of different, not empty sets, by the shingles they share."""
    holders, both = {}, Counter()
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for at in holders.values():
        both.update((a, b) for k, b in enumerate(at) for a in at[:k])
    return {(a, b) for (a, b), n in both.items() if n >= least * (len(sets[a]) + len(sets[b]) - n)}


def survivors(texts):
    """Positions that are the smallest of their component over both kinds of links."""
    fps, parent = [simhash.fingerprint((t or "").encode()) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 3} if len(fps) <= 1000 else set()
    for a, b in near | alike_pairs(sets_of(texts)):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [i for i in range(len(texts)) if find(i) == i]


def test_near_copies_go(spark):
    """On the given table: SimHash's 3 bits alone leave pairs of 0.8 and more."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = [rows[i]["doc_id"] for i in survivors([r["text"] for r in rows])]
    got = simhash.unique(docs).where("doc_id IS NOT NULL").select("doc_id", "text").orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == want
    assert not alike_pairs(sets_of([r["text"] for r in got]))


def test_edited_copies_are_one(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    texts = [" ".join(words)]
    for edits in (4, 8, 10):
        other = list(words)
        for i in rng.sample(range(600), edits):
            other[i] = "changed"
        texts.append(" ".join(other))
    texts.append(" ".join(words[300:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r[0] for r in simhash.unique(df).collect()) == survivors(texts) == [0, 4]


@pytest.mark.parametrize("most", [150, jaccard.MOST])
def test_blocks_lose_nothing(spark, most):
    """A chain of near copies and a star of them, in one block and in many."""
    rng, rows = random.Random(6), []
    for _ in range(4):
        words = [f"v{rng.randrange(9000)}" for _ in range(80)]
        for i in range(12):
            words[i * 6] = f"z{rng.randrange(9000)}"
            rows.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    common.small_batches(spark)
    roots = {r["doc_id"]: r["root"] for r in df.select("doc_id", F.xxhash64("text").alias("text_key")).join(simhash.alike(df, most=most), "text_key").collect()}
    assert len(set(roots.values())) == len(survivors(rows)) == 4


def test_rows_without_or_with_repeated_ids(spark, docs, empty):
    """Every group of alike texts keeps exactly one row, whatever its ids."""
    a, b, c, d = (" ".join(f"{x}{i * i % 97}" for i in range(40)) for x in "abcd")
    rows = [(None, a, "en"), (None, a, "fr"), (None, b, "en"), (7, c, "en"), (7, d, "en"), (None, c, "en"), (3, d, "fr"), (7, c, "en"), (None, "", "en"), (None, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_unique(spark, df, SF).collect()
    assert len(got) == 5 and sorted((r["text"] or "", r["doc_id"]) for r in got) == [("", None), (a, None), (b, None), (c, 7), (d, 3)]
    kept = corpus_pipeline.near_unique(spark, docs, SF)
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and sorted(x for x in ids if x is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14] and ids.count(None) == 1
    assert corpus_pipeline.near_unique(spark, empty, SF).count() == 0
