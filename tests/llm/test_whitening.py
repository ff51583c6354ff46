"""op13 against an exact version in Python's whole numbers and fractions."""

import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows, weights="one", components=16):
    whole = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in whole]
    sizes = Counter(len(x) for _, x in xs)
    d = min(sizes, key=lambda k: (-sizes[k], k))
    count = Counter(x for _, x in xs if len(x) == d)
    w = {x: c if weights == "counts" else 1 for x, c in count.items()}
    n = sum(w.values())
    total = [sum(x[j] * w[x] for x in w) for j in range(d)]
    cov = [[float(sum(w[x] * (x[i] - Fraction(total[i], n)) * (x[j] - Fraction(total[j], n)) for x in w) / n) for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array(cov))
    return xs, d, n, total, values[::-1][:components], vectors[:, ::-1][:, :components]


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_equals_brute_force(spark, weights):
    rng = np.random.default_rng(3)
    base = [[float(np.float32(c)) for c in rng.normal(size=6) * [1, 2, 3, 4, 5, 6] * 0.1] for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else base[0]) for i in range(150)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (None, base[1]), (7, base[1])]
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, copies int").repartition(4)
    out = whitening.whiten(df, weights=weights).collect()
    xs, d, n, total, values, vectors = brute(rows, weights)
    assert Counter(r["vec_id"] for r in out if r["component"] is None) == Counter([904, 905])
    got = {}
    for r in out:
        if r["component"] is not None:
            got.setdefault(r["vec_id"], []).append(r)
    assert Counter(len(v) for k, v in got.items() if k != 7) == {6: 150}  # ids 0 to 149 but the repeated 7, and the null id
    assert len(got[7]) == 12
    signs = None
    for i, x in xs:
        if len(x) != d:
            continue
        z = np.array([float(x[j] - Fraction(total[j], n)) for j in range(d)]) @ vectors / np.sqrt(values)
        dev = sum((n * x[j] - total[j]) ** 2 for j in range(d))
        if i == 7:
            continue
        mine = sorted(got[i], key=lambda r: r["component"])
        have = np.array([r["whitened"] for r in mine])
        signs = np.sign(have * z) if signs is None else signs
        assert np.allclose(have, signs * z, atol=1e-9)
        assert all(r["deviation"] == dev and r["n"] == n and r["identity_error"] < 1e-9 for r in mine)
        assert np.allclose([r["explained"] for r in mine], values / np.trace(np.diag(values)), rtol=1e-9)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"], r["deviation"], r["identity_error"]) for r in same) == [(i, c, None, 0, None) for i in (1, 2) for c in (1, 2)]
    far = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")).collect()
    assert len(far) == 6 and all(r["deviation"] > 1 << 63 for r in far if r["vec_id"] < 3)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}


def test_query(spark):
    out = whitening.op13_whitening(spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = out.collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert len(rows) == 16 * table.count() and max(r["identity_error"] for r in rows) < 1e-9
