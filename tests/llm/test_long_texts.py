"""Toxicity of texts of a million characters, made of held-out ones."""

import random

from pyspark.sql import functions as F

from tallyloom.llm import common, toxicity

SF = "/root/testdata/sf0.1"


def test_length_does_not_decide(spark):
    common.small_batches(spark)
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = common.fold(F.col("doc_id"), 4) == 2
    score = toxicity.scorer(spark, toxicity.fit(docs, labels, "toxic", ~held))
    pools = {0: [], 1: []}
    for r in docs.join(labels, "doc_id").where(held & F.col("toxic").isNotNull() & F.col("text").isNotNull()).orderBy("doc_id").collect():
        pools[r["toxic"]].append(r["text"])
    rng, rows = random.Random(1), []
    for i in range(40):
        long = rng.choices(pools[0], k=440)
        rows.append((0, "\n".join(long)))
        if i < 10:
            rows.append((1, "\n".join(rng.choices(pools[1], k=440))))
            rows.append((2, "\n".join([*long, *rng.choices(pools[1], k=50)])))  # the last tenth is toxic
    long = spark.createDataFrame(rows, "kind int, text string").repartition(8)
    got = long.select("kind", F.length("text").alias("n"), (score("text") >= 0.3).alias("toxic")).collect()
    count = {k: sum(r["toxic"] for r in got if r["kind"] == k) for k in range(3)}
    print(count, sum(r["n"] for r in got) / len(got))
    assert sum(r["n"] for r in got) / len(got) > 900_000
    assert count == {0: 0, 1: 10, 2: 10}


def test_one_window_is_enough():
    """A toxic window counts among 1, 20 and 200, and a text's score falls evenly with the log of its windows."""
    import numpy as np

    dense, marks = np.zeros(2**10 + 1), np.zeros(2**10 + 1, np.uint64)
    word = toxicity.hashes(b"vile")[0][0]
    dense[word >> np.uint64(54)], marks[word >> np.uint64(54)] = 9.0, word
    for n in (1, 19, 20, 21, 200):
        for at in (0, 1000, 2000 * n - 1):
            words = [b"calm"] * (2000 * n)
            words[at] = b"vile"
            assert abs(toxicity.raw_score(b" ".join(words), dense, marks, 10) - (9.0 - toxicity.LENGTH * np.log(n))) < 1e-9
