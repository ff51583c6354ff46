"""op12 against brute force: every pair of words tried, counts by a plain loop, roots followed one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyloom.llm import spelling


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1 :] or (len(x) == len(y) and x[i + 1 :] == y[i + 1 :])


def brute(docs, least_length=6, least=5, ratio=5, error=199):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if error and h % error == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_pairs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé"[: 2 + seed % 2]) for _ in range(rng.randrange(seed % 3 and 1, 7))) for _ in range(60)})
    got = list(spelling.near_pairs(words))
    assert len(got) == len(set(got)) == len({tuple(sorted(p)) for p in got})
    assert {tuple(sorted(p)) for p in got} == {(x, y) for x in words for y in words if x < y and near(x, y)}


def test_acceptor_is_minimal():
    words = ["tap", "taps", "top", "tops"]
    machine = spelling.Acceptor(words)
    assert machine.common(machine.start, machine.start).sort() is None and sorted(machine.common(machine.start, machine.start)) == words
    assert len(machine.arcs) == 5  # start, t, ta = to, tap = top, end
    assert spelling.Acceptor([]).arcs == [()] and not spelling.Acceptor([]).final[0]
    assert spelling.Acceptor(["", "a"]).final[spelling.Acceptor(["", "a"]).start]


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abéz") for _ in range(rng.randrange(5, 12))) for _ in range(25)] + ["a" * 6, "a" * 7, "a" * 40]
    pool = []
    for w in stems:
        pool += [w] * rng.choice([1, 6, 40, 300])
        for _ in range(3):
            i = rng.randrange(len(w))
            pool += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]])] * rng.choice([1, 5, 7, 50])
    rng.shuffle(pool)
    docs = [(i, " ".join(w.upper() if i % 3 == 0 and w.isascii() else w for w in pool[i * 20 : i * 20 + 20]) + ". x1y") for i in range(len(pool) // 20)]
    docs += [(None, "abcdefg abcdefg, abcdefg"), (5, None), (6, ""), (7, " \t"), (7, "l×ngword " * 5 + "İstanbul ſsssssss"), (8, "b" * 3000 + " " + "b" * 3001), (8, ("b" * 3000 + " ") * 5), (8, ("b" * 3001 + " ") * 30)]
    df = spark.createDataFrame([(a, b, "w", 1) for a, b in docs], "doc_id long, text string, word string, n int").repartition(3)
    for error in (199, 3):
        got = spelling.variants(spelling.vocabulary(df, error=error))
        assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, error=error))
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_odd_rows(spark, docs, empty, rows):
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    got = spelling.variants(spelling.vocabulary(docs, least=1, error=199)).collect()
    want = brute([(r[0], r[1]) for r in rows], least=1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
