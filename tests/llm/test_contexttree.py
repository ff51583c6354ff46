"""op11 against context-tree weighting written out by recursion, and its base against plain counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import common, contexttree

SF = "/root/testdata/sf0.001"


class Brute:
    """A context tree of each code-tree node, as dictionaries."""

    def __init__(self, texts):
        self.count = Counter()
        for t in texts:
            for past, byte in self.steps(t):
                for level in range(8):
                    for depth in range(6):
                        self.count[1 << level | byte >> (8 - level), past[:depth], byte >> (7 - level) & 1] += 1
        self.longer = {}
        for node, past, _ in list(self.count):
            if past:
                self.longer.setdefault((node, past[:-1]), set()).add(past)
        self.log = {}

    @staticmethod
    def steps(text):
        padded = b"\n" * 5 + text
        return [(bytes(reversed(padded[i - 5 : i])), padded[i]) for i in range(5, len(padded))]

    def kt(self, node, past):
        a, b = (self.count[node, past, bit] for bit in (0, 1))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node, past):
        if (node, past) not in self.log:
            kt = self.kt(node, past)
            if len(past) < 5:
                rest = sum(self.weighted(node, x) for x in self.longer.get((node, past), ()))
                kt = np.logaddexp(math.log(0.5) + kt, math.log(0.5) + rest)
            self.log[node, past] = float(kt)
        return self.log[node, past]

    def chance(self, node, past, bit):
        out = None
        for depth in range(5, -1, -1):
            s = past[:depth]
            a, b = (self.count[node, s, x] for x in (0, 1))
            own = ((a, b)[bit] + 0.5) / (a + b + 1)
            w = 1 if depth == 5 else math.exp(math.log(0.5) + self.kt(node, s) - self.weighted(node, s)) if a + b else 0.5
            out = own if out is None else w * own + (1 - w) * out
        return out

    def score(self, text):
        return sum(math.log10(self.chance(1 << level | byte >> (8 - level), past, byte >> (7 - level) & 1)) for past, byte in self.steps(text) for level in range(8))


def held(doc_id, parts=10):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % parts == 0


def expected(docs):
    done = [(i, [w for w in (t or "").encode().lower().split()]) for i, t in docs]
    learned = [w for i, w in done if held(i) is False]
    c = Counter(x for w in learned for x in [*w, None])
    n, v = sum(c.values()), len(c)
    model = Brute([b" ".join(w) + b"\n" for w in learned])
    out = []
    for i, w in done:
        each = [c[x] for x in [*w, None]]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in each)
        text = b" ".join(w) + b"\n"
        out.append((i, held(i), len(each), sum(x > 0 for x in each), len(text), n, base, model.score(text)))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), *r[2:6], round(r[6], 3))
    got, want = sorted((tuple(r)[:8] for r in got), key=key), sorted(want, key=key)
    assert [r[:6] for r in got] == [r[:6] for r in want]
    assert np.allclose([r[6:] for r in got], [r[6:] for r in want], rtol=1e-8, atol=1e-8)


@pytest.mark.parametrize("part", [1, 300, 1 << 20])
def test_equals_recursion(spark, part, monkeypatch):
    rng = random.Random(part)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    docs = [(i, " \n".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    docs += [(None, "abc never LEARNED"), (3, None), (3, ""), (44, "你 \U0001f600 x"), (44, "你 \U0001f600 x"), (45, " \t ")]
    df = spark.createDataFrame([(a, b, "k", 1) for a, b in docs], "doc_id long, text string, key string, part int").repartition(3)
    monkeypatch.setattr(contexttree, "PIECE", 64)  # texts are cut into windows
    same(contexttree.score(df, common.fold(F.col("doc_id"), 10) == 0, part=part).collect(), expected(docs))


def test_small_batches_of_subtrees(monkeypatch):
    rng = np.random.default_rng(0)
    import pyarrow as pa

    monkeypatch.setattr(contexttree, "KEYS", 8)
    slices = [np.unique(rng.integers(0, 3, 30) << 24 | rng.integers(0, 50, 30)) for _ in range(9)]
    rows = [(k, b"%d" % i) for i, s in enumerate(slices) for k in (-1, *s.tolist())]
    for size in (1, 2, 7, 64):
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[i : i + size]], pa.int64()), pa.array([1] * len(rows[i : i + size])), pa.array([r[1] for r in rows[i : i + size]], pa.binary())], names=["key", "n", "above"]) for i in range(0, len(rows), size)]
        got, trees = [], []
        for k, _, o, above in contexttree._whole(iter(batches)):
            got += [(int(a), above[int(b)]) for a, b in zip(k, o, strict=True)]
            trees.append({(int(a) >> 24, above[int(b)]) for a, b in zip(k, o, strict=True)})
        assert got == [r for r in rows if r[0] >= 0]
        assert sum(map(len, trees)) == len(set().union(*trees))  # no subtree is cut


def test_probabilities_sum_to_one(spark):
    keys = contexttree.keys_of(np.frombuffer(b"\n" * 5 + b"some text to learn, some text\n", np.uint8))
    found, n = np.unique(keys, return_counts=True)
    contexts = {int(found[0]) >> 8, int(found[9]) >> 8, (int(found[9]) >> 8) ^ 3, 0}
    asked = {(c << 8 | b): 0 for c in contexts for b in range(256)} | dict(zip(found.tolist(), n.tolist(), strict=True))
    got = dict(contexttree.log_probabilities(spark.createDataFrame(list(asked.items()), "key long, n long")).collect())
    for c in contexts:
        assert abs(sum(10 ** got[c << 8 | b] for b in range(256)) - 1) < 1e-9
    longest = np.array([0.5, 3.0, 8.0, 1e6])
    assert np.allclose(contexttree.log_gamma(longest), [math.lgamma(x) for x in longest], rtol=1e-12, atol=1e-12)


def test_odd_rows(spark, docs, empty, rows):
    assert contexttree.score(empty, F.lit(False)).count() == 0
    short = docs.where("doc_id IS NULL OR doc_id <> 9")  # the recursion is slow on long texts
    same(contexttree.score(short, common.fold(F.col("doc_id"), 10) == 0).collect(), expected([(r[0], r[1]) for r in rows if r[0] != 9]))
    unlearned = contexttree.score(docs.where("doc_id < 4"), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"] - 8 * r["n_bytes"] * math.log10(0.5)) < 1e-9 for r in unlearned)


def test_held_out_texts(spark):
    out = contexttree.op11_contexttree(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_bytes")).first()
    assert out[0] > out[1] and -out[0] / out[2] * math.log2(10) < 2.3
