"""Classifiers and language ID: held-out accuracy on the small tables, and odd rows."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import common, langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def held_out(spark, out, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = out.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col(label).alias("y")).toPandas()
    order = got["score"].rank()
    n = got["y"].sum()
    auc = (order[got["y"] == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n))
    return auc, (got["predicted"] == got["y"]).mean()


def test_quality_held_out(spark):
    out = quality.op1_quality(spark, SF).cache()
    assert out.count() == 1000 and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    auc, accuracy = held_out(spark, out, "quality")
    assert auc > 0.95 and accuracy > 0.9
    ids = {r[0]: r[1] for r in out.select("doc_id", "held_out").collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in ids.items())


def test_quality_prior_and_risk():
    rng = np.random.default_rng(0)
    positive = np.concatenate((rng.normal(1, 1, (2000, 3)), np.ones((2000, 1))), axis=1).astype(np.float32)
    mixed = np.concatenate((rng.normal(1, 1, (1400, 3)), rng.normal(-3, 1, (600, 3))))
    mixed = np.concatenate((mixed, np.ones((2000, 1))), axis=1).astype(np.float32)
    rng.shuffle(mixed)
    prior = quality.estimate_prior(positive, mixed)
    assert 0.62 < prior < 0.78
    w = quality.minimise(positive, mixed, prior)
    assert ((positive @ w) > 0).mean() > 0.97 and abs(((mixed @ w) > 0).mean() - 0.7) < 0.06


def test_toxicity_held_out(spark):
    out = toxicity.op3_toxicity(spark, SF).cache()
    auc, accuracy = held_out(spark, out, "toxic")
    assert out.count() == 1000 and auc > 0.8 and accuracy > 0.9


def test_ftrl_equals_brute_force():
    """One coordinate at a time, with the closed form of its weight."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, rng.integers(1, 20))).astype(np.int32) for _ in range(150)]
    y = np.array([float((r < 12).sum() > 2) for r in rows])
    z, n, last = {}, {}, 64

    def weight(i):
        zz, l1 = z.get(i, 0.0), 0.0 if i == last else toxicity.L1
        return 0.0 if abs(zz) <= l1 else -(zz - (l1 if zz > 0 else -l1)) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.arange(len(rows))
    for epoch in range(toxicity.EPOCHS):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            at = [*rows[k].tolist(), last]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[k]
            for i in at:
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = toxicity.fit_rows(rows, y, bits=6)
    assert np.abs(got - [weight(i) for i in range(last + 1)]).max() < 1e-9 and 0 < (got[:-1] != 0).sum() < 60


def test_risk_step_equals_brute_force():
    """The first steps of the non-negative risk, term by term, with the gradient turned where the bracket is negative."""
    rng = np.random.default_rng(6)
    p, u, prior = rng.normal(1, 1, (40, 3)).astype(np.float32), rng.normal(0, 1, (60, 3)).astype(np.float32), 0.9
    draw, w, m, v, turned = np.random.default_rng(7), np.zeros(3), np.zeros(3), np.zeros(3), 0
    sig, mean = lambda a: 1 / (1 + np.exp(-a)), np.zeros(3)
    for t in range(1, 61):
        a, b = p[draw.integers(0, 40, quality.BATCH)].astype(float), u[draw.integers(0, 60, quality.BATCH)].astype(float)
        g_pos = sum(-sig(-(x @ w)) * x for x in a) / len(a)
        g_neg = sum(sig(x @ w) * x for x in b) / len(b) - prior * sum(sig(x @ w) * x for x in a) / len(a)
        bracket = np.log1p(np.exp(b @ w)).mean() - prior * np.log1p(np.exp(a @ w)).mean()
        turned += bracket < 0
        g = (prior * g_pos + g_neg if bracket >= 0 else -g_neg) + quality.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - quality.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        mean += w / 30 if t > 30 else 0
    got = quality.minimise(p, u, prior, steps=60)
    assert np.abs(got - mean).max() < 1e-3 and turned  # single precision


def test_shares_of_hashes():
    assert common.below(1) == common.below(7) == (1 << 63) - 1 and common.below(0) == -(1 << 63)
    assert common.below(1e-12) + (1 << 63) == int(1e-12 * (1 << 64)) > 0  # 4,000 of 4e15 rows are some


def test_ftrl_is_sparse_and_right():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 1000, 30), [3] if i % 4 == 0 else [4])).astype(np.int32) for i in range(800)]
    w = toxicity.fit_rows(rows, np.array([float(i % 4 == 0) for i in range(800)]), bits=10)
    assert w[3] > 1 and (w[:-1] != 0).mean() < 0.05


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows_and_no_labels(spark, docs, empty, module, label):
    common.small_batches(spark)
    labels = spark.createDataFrame([(i, i % 2) if i else (None, None) for i in range(12)], f"doc_id long, {label} int")
    for table, count in ((docs, 17), (empty, 0)):
        model = module.fit(table, labels, label)
        score = module.scorer(spark, model if module is toxicity else model[0])
        got = [r[0] for r in table.select(score("text").alias("s")).collect()]
        assert len(got) == count and all(0 <= x <= 1 for x in got)
    model = module.fit(docs, labels.limit(0), label)
    score = module.scorer(spark, model if module is toxicity else model[0])
    assert docs.select(score("text").alias("s")).count() == 17


def test_language(spark):
    out = langid.op5_langid(spark, SF).cache()
    assert out.count() == 1250
    assert out.where("lang = declared").count() >= 1240 and out.where("kind = 'document' AND kept").count() >= 990


def test_language_fuses_evidence(spark):
    """A text of shared words: the host's other texts decide; a lone false declaration does not."""
    english, french = "the house and the tree of water", "la maison et le arbre de eau"
    rows = [(i, english if i % 2 else french, "en" if i % 2 else "fr", "a.example.com" if i % 2 else "b.example.fr") for i in range(200)]
    rows += [(1000, "house maison", None, "b.example.fr"), (1001, "house maison", None, "a.example.com"), (1002, english, "fr", "a.example.com"), (1003, "", "en", "a.example.com"), (1004, None, None, None), (1005, english, "xx", None)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string")
    got = {r["id"]: r for r in langid.identify(df).collect()}
    assert got[1000]["lang"] == "fr" and got[1001]["lang"] == "en" and got[1002]["lang"] == "en" and got[1005]["lang"] == "en"
    assert got[1003]["lang"] == got[1004]["lang"] == "und" and not got[1003]["kept"]


def test_language_rejects_what_is_none(spark):
    """Random letters, digits, symbols and unknown scripts go, whatever they declare; texts of the corpus stay."""
    rng = np.random.default_rng(1)
    alphabets = ["bcdfghjklmnpqrstvwxz", "0123456789", "#$%&*|<>=+", "абвгдежзиклмнопрст", "漢字仮名交文章書語"]
    odd = [" ".join("".join(rng.choice(list(a), rng.integers(2, 9))) for _ in range(60)) for a in alphabets for _ in range(4)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    planted = spark.createDataFrame([(-1 - i, t, ["en", None][i % 2], "src0") for i, t in enumerate(odd)], docs.schema)
    out = langid.identify(docs.union(planted)).cache()
    assert out.where("doc_id < 0 AND (kept OR lang <> 'und')").count() == 0
    assert out.where("doc_id >= 0 AND NOT kept").count() <= 5


def test_language_many_and_rare(spark):
    """No bound on languages; a rare one is found, and so is one beside a hot one."""
    rows = [(i, f"wo{i % 90:02d}ba la{i % 90:02d}te mi{i % 90:02d}", "abcdefghijklmnopqrstuvwxyz"[i % 90 // 26] + "abcdefghijklmnopqrstuvwxyz"[i % 90 % 26], "h") for i in range(900)]
    rows += [(i, f"common{i % 50} words here", "zz", "h") for i in range(1000, 4000)] + [(5000 + i, f"rare{i} wenig tok{i}", "yy", "h") for i in range(3)]
    out = langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string"), max_rows=40)
    assert out.select("lang").distinct().count() >= 92
    assert out.where("id >= 5000 AND lang = 'yy'").count() == 3 and out.where("id < 900 AND lang <> declared").count() == 0


def test_a_stray_code_is_no_language(spark):
    rows = [(i, f"the house number {i} stands by water {i % 7}", "en") for i in range(300)] + [(300, "strange words of one text", "zz")] + [(301 + i, f"strange words of one text {i}", None) for i in range(5)]
    out = langid.identify(spark.createDataFrame([(*r, "h") for r in rows], "id long, text string, declared string, host string"))
    assert {r[0] for r in out.select("lang").distinct().collect()} <= {"en", "und"}


def bayes(rows, max_rows=10**9):
    """The fusion of identify() word by word, in plain Python."""
    import math
    from collections import Counter, defaultdict

    def buckets(text):
        out = []
        for w in (text or "").encode().split():
            x = w.strip(langid.EDGE).decode().lower()
            if x:
                out.append([xxhash.xxh32_intdigest(p, k) >> 32 - langid.BITS for k, p in enumerate((x, x[:3], x[-3:]))])
        return out

    size = 1 << langid.BITS
    seen = defaultdict(Counter)
    said = Counter((t, d) for _, t, d, _ in rows if t is not None and d)
    for text in {t for t, _ in said}:
        declared = max((n, d) for (t, d), n in said.items() if t == text)[1]
        seen[declared].update(x for w in buckets(text) for x in w)
    owners = Counter()
    for text in {t for t, _ in said}:
        n, declared = max((n, d) for (t, d), n in said.items() if t == text)
        owners[declared] += n
    names = sorted(n for n in seen if seen[n] and owners[n] >= langid.LEAST_ROWS)
    total = {n: sum(seen[n].values()) for n in names}
    like, back = [], []
    for _, t, _, _ in rows:
        b = [x for w in buckets(t) for x in w]
        scale = min(len(b) // 3, langid.CAP) / (len(b) // 3) if b else 0
        like.append([scale * sum(math.log((1 - langid.UNSEEN) * seen[n][x] / total[n] + langid.UNSEEN / size) for x in b) for n in names])
        back.append(scale * len(b) * math.log(1 / size))
    best = [max(range(len(names)), key=lambda i: (v[i], -i)) for v in like]
    some = [bool((t or "").split()) for _, t, _, _ in rows]
    said = Counter((d, names[b]) for (_, _, d, _), b, s in zip(rows, best, some, strict=True) if s and d in names)
    worth = {d: [math.log((1 + said[d, n]) / sum(1 + said[e, n] for e in names)) for n in names] for d in names}

    def counts(key):
        c = defaultdict(lambda: [0.0] * len(names))
        for (_, _, _, h), b, s in zip(rows, best, some, strict=True):
            if s and h is not None:
                c[key(h)][b] += 1
        return c

    def smooth(own, above):
        return [(x + langid.STRENGTH * p) / (sum(own) + langid.STRENGTH) for x, p in zip(own, above, strict=True)]

    domain, suffix = lambda h: ".".join(h.split(".")[-2:]), lambda h: h.split(".")[-1]
    every = [0.0] * len(names)
    for (_, _, _, h), b, s in zip(rows, best, some, strict=True):
        every[b] += s
    root = [(x + 1) / (sum(every) + len(names)) for x in every]
    by_suffix = {k: smooth(v, root) for k, v in counts(suffix).items()}
    by_domain = {k: smooth(v, by_suffix[suffix(k)]) for k, v in counts(domain).items()}
    by_host = {k: smooth(v, by_domain[domain(k)]) for k, v in counts(lambda h: h).items()}
    out = {}
    for (i, _, d, h), v, bg, s in zip(rows, like, back, some, strict=True):
        if not s:
            out[i] = ("und", 0.0)
            continue
        f = [x + math.log(p) + w for x, p, w in zip(v, by_host.get(h, root), worth.get(d, [0.0] * len(names)), strict=True)]
        b = bg + math.log(langid.BACKGROUND) - (math.log(len(names)) if d in names else 0)
        top = max([*f, b])
        i_best = max(range(len(f)), key=lambda k: (f[k], -k))
        out[i] = (names[i_best] if f[i_best] >= b else "und", math.exp(top - top) / sum(math.exp(x - top) for x in [*f, b]))
    return out


def test_language_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = {"en": ["the", "house", "tree", "and", "of"], "fr": ["la", "maison", "arbre", "et", "de"], "de": ["das", "haus", "baum", "und", "von"]}
    rows = []
    for i in range(240):
        l = ["en", "fr", "de"][rng.integers(3)]
        text = " ".join(rng.choice(words[l] + ["x", "de"], rng.integers(1, 50)))
        rows.append((i, text, [l, l, l, "en", None, "qq"][rng.integers(6)], [f"a.{l}.org", "b.c.net", "c.net", None][rng.integers(4)]))
    rows = [(i, t, d if d != "qq" else "", h) for i, t, d, h in rows] + [(900, "", "en", "c.net"), (901, None, None, None)]
    want = bayes(rows)
    got = {r["id"]: (r["lang"], r["posterior"]) for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string")).collect()}
    assert {i: l for i, (l, _) in got.items()} == {i: l for i, (l, _) in want.items()}
    assert all(abs(got[i][1] - p) < 1e-4 for i, (_, p) in want.items())  # the model's table is in single precision


def test_language_odd_rows(docs, empty):
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), "kept")
    out = langid.identify(rows).collect()
    assert len(out) == 17
    assert langid.identify(rows.limit(0)).count() == 0
    assert langid.identify(rows.withColumn("declared", F.lit(None).cast("string"))).where("lang = 'und'").count() == 17
