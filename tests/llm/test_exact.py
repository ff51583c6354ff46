"""Operators with one right answer: brute force, round trips, SQL."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import bpe, components, gif, mixing, ngramratio, presplit, rans, simhash, urlrange

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def as_sql(df, text, **tables):
    con = duckdb.connect()
    for n in TABLES:
        if n in tables:
            con.register(f"_{n}", tables[n])
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM _{n}")
        else:
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = con.execute(text)
    have, names = [x[0] for x in want.description], sorted(df.columns)
    assert sorted(have) == names
    rows = sorted(repr(tuple(r[have.index(c)] for c in names)) for r in want.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == rows


# ---- op2


def test_lzw_round_trip():
    rng = random.Random(1)
    for data in (b"", b"a", b"a" * 5000, b"ab" * 30_000, bytes(rng.randrange(256) for _ in range(20_000)), bytes(rng.randrange(3) for _ in range(60_000))):
        for bits in (8, 4, 2):
            samples = bytes(x % (1 << bits) for x in data)
            got, sound = gif.lzw_unpack(gif.lzw_pack(samples, bits), bits)
            assert sound and got.tobytes() == samples


def plain_lzw(stream, bits):
    """Code after code with a table of strings, as the format describes it."""
    clear, end = 1 << bits, (1 << bits) + 1
    have, out, table, width, last, at = int.from_bytes(stream, "little"), [], [], bits + 1, None, 0
    while at + width <= 8 * len(stream):
        code = have >> at & ((1 << width) - 1)
        at += width
        if code == end:
            return b"".join(out), True
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if last is None:
            text = table[code]
        else:
            if code > len(table):
                return b"".join(out), False
            text = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + text[:1])
                width = min(12, max(width, len(table).bit_length()))
        out.append(text)
        last = text
    return b"".join(out), False


def packed(codes, bits, full=True):
    """A stream of these codes after a clear code; past a full table no clear code comes."""
    have, at, size, width = 1 << bits, bits + 1, (1 << bits) + 2, bits + 1
    for i, code in enumerate([*codes, (1 << bits) + 1]):
        have |= code << at
        at += width
        if i and size < 4096:
            size += 1
            width = min(12, max(width, size.bit_length()))
    return have.to_bytes((at + 7) // 8, "little")


def test_lzw_equals_a_plain_decoder():
    rng = random.Random(4)
    for bits in (2, 4, 8):
        for n in (0, 1, 5000, 60_000):
            samples = bytes(rng.randrange(1 << bits) if rng.random() < 0.3 else 1 for _ in range(n))
            assert plain_lzw(gif.lzw_pack(samples, bits), bits) == (samples, True)
        first = (1 << bits) + 2
        codes = [0, *(min(first + rng.randrange(i), 4095) if rng.random() < 0.5 else rng.randrange(1 << bits) for i in range(1, 6000))]
        stream = packed(codes, bits)
        want, sound = plain_lzw(stream, bits)
        got, fine = gif.lzw_unpack(stream, bits)
        assert got.tobytes() == want and fine == sound
        short, _ = gif.lzw_unpack(stream, bits, 1000)
        assert short.tobytes()[:1000] == want[:1000] and len(short) < 1000 + 4096


def test_lzw_expansion_is_cut():
    """A megabyte of codes that each stand for thousands of samples."""
    import tracemalloc

    stream = packed([0, *range(258, 4096), *[4095] * 700_000], 8)
    assert len(stream) > 1_000_000
    tracemalloc.start()
    got, _ = gif.lzw_unpack(stream, 8, 4096)
    assert 4096 <= len(got) < 10_000 and not got.any() and tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_gif_feature(spark):
    """Frames, time and the four commonest colours, counted from the text itself."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()
    have = {r["doc_id"]: r["feature"] for r in gif.op2_gif(spark, SF).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        grey = Counter(b >> 6 for b in raw)
        named = [(f"{k}{k}{k}", grey[k]) for k in range(4)] + [(f"{i // 16}{i // 4 % 4}{i % 4}", 0) for i in range(64) if i % 21]
        top = sorted(named, key=lambda x: (-x[1], x[0]))[:4]
        frames = -(-len(raw) // (64 * 4096))
        assert have[doc_id] == f"frames={frames};ms={40 * frames};" + ",".join(f"{k}:{n}" for k, n in top)


def test_gif_disposal_transparency_interlace():
    def frame(samples, left, top, w, h, disposal, clear=None, interlaced=False):
        codes = gif.lzw_pack(bytes(samples), 2)
        control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        place = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 * interlaced, 2, len(codes)])
        return control + place + codes + b"\x00"

    head = b"GIF89a" + (2).to_bytes(2, "little") + (2).to_bytes(2, "little") + bytes([0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    raw = head + frame([1, 1, 1, 1], 0, 0, 2, 2, 1) + frame([2, 0], 0, 0, 2, 1, 2, clear=0) + frame([3], 1, 1, 1, 1, 3) + frame([2, 2, 2, 2], 0, 0, 2, 2, 0, clear=2) + b"\x3b"
    canvases, starts = [], []
    for f in gif.frames_of(raw):
        canvases.append(f["canvas"].copy())
        starts.append(f["start_ms"])
        assert not f["error"]
    red, green, blue, none = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert canvases[0].tolist() == [[red, red], [red, red]]
    assert canvases[1].tolist() == [[green, red], [red, red]]
    assert canvases[2].tolist() == [[none, none], [red, blue]]  # the second frame's place was cleared
    assert canvases[3].tolist() == [[none, none], [red, red]]  # the third frame's place was restored
    assert starts == [0, 50, 100, 150] and gif.histogram(canvases[3])[0b110000] == 2
    tall = head[:8] + (5).to_bytes(2, "little") + head[10:] + frame([0, 1, 2, 3, 1], 0, 0, 1, 5, 1, interlaced=True) + b"\x3b"
    assert next(iter(gif.frames_of(tall)))["samples"].ravel().tolist() == [0, 3, 2, 1, 1]
    vast = b"GIF89a" + b"\xff" * 4 + bytes(4)
    assert [f["error"] for f in gif.frames_of(vast)] == [True]  # neither canvas nor frame is laid out
    wide = head + b"\x2c" + bytes(4) + b"\xff" * 4 + bytes([0, 2, 1, 0, 0]) + b"\x3b"
    assert [f["error"] for f in gif.frames_of(wide)] == [True]
    rng = random.Random(5)
    for _ in range(300):  # damage anywhere: frames or an error, no exception
        broken = bytearray(raw)
        broken[rng.randrange(len(raw))] = rng.randrange(256)
        assert all(isinstance(f["error"], bool | np.bool_) for f in gif.frames_of(bytes(broken)))
    assert [f["error"] for f in gif.frames_of(raw[:-20])][-1] and [f["error"] for f in gif.frames_of(b"no")] == [True]


def test_gif_query(spark, docs):
    got = {r["doc_id"]: r for r in gif.op2_gif(spark, SF).collect()}
    for i, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        payload = gif.pad(text.encode())
        assert (got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    media = gif.encode(docs, "doc_id", "text")
    frames = gif.decode(media).where("NOT error").orderBy("frame").collect()
    parts = {}
    for f in frames:
        parts.setdefault(f["id"], []).append(bytes(f["samples"]))
    for r in docs.where("text IS NOT NULL AND doc_id IS NOT NULL").collect():
        assert b"".join(parts[r["doc_id"]]).startswith(gif.pad(r["text"].encode()))
    assert gif.decode(media.limit(0)).count() == 0


# ---- op4


def test_ratio_equals_sql(spark, docs):
    as_sql(ngramratio.op4_llr(spark, SF), ngramratio.OP4_SQL)
    docs = docs.where("doc_id <> 9")  # the SQL lays out every window of a text
    rows = docs.select("doc_id", "text")
    labels = spark.createDataFrame([(8, 1, 0), (9, 1, 0), (10, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = ngramratio.judge(docs, ngramratio.weights(docs, labels.where("quality = 1")))
    as_sql(out, ngramratio.OP4_SQL, documents=rows.toArrow(), labels=labels.toArrow())


def test_ratio_long_text(docs):
    """A long text without and with repeats, against a direct count."""
    text = docs.where("doc_id = 9").first()["text"]
    words = text.split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    got = ngramratio.judge(docs, ngramratio.weights(docs, docs.limit(0))).where("doc_id = 9").first()
    assert (got["n_words"], got["n_repeat_words"], got["word_chars"]) == (len(words), len(inside), sum(map(len, words)))


def test_ratio_of_many_targets(docs):
    """Beyond the bound of broadcast ids the same weights come out."""
    ids = docs.where("doc_id IN (4, 7, 8, 10)").select("doc_id")
    assert ngramratio.weights(docs, ids, most=1) == ngramratio.weights(docs, ids)


def test_ratio_empty(docs, empty):
    assert ngramratio.judge(empty, ngramratio.weights(empty, empty)).count() == 0
    model = ngramratio.weights(docs, empty)
    assert not any(model) and ngramratio.judge(docs, model).count() == 17


# ---- op6


def test_urls_equal_sql_and_brute_force(spark):
    as_sql(urlrange.op6_url_filter(spark, SF), urlrange.OP6_SQL)
    hosts, paths = ["a.b.c", "b.c", "xb.c", "c", "", "d.b.c", "B.C"], ["/", "/x/", "/x/y", "", "/X/"]
    urls = [f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/", "#f")] + [None, "", "b.c/x", "no://", "a://b.c/x://y"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls * 3)], "page_id long, url string, host string")
    rules = [("block", "c", "/"), ("allow", "b.c", "/x/"), ("block", "a.b.c", "/x/"), ("allow", "b.c", "/"), ("block", "b.c", "/"), ("block", "zz", "/"), ("block", None, "/")]
    got = {r["page_id"]: r for r in urlrange.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert len(got) == len(urls) * 3
    for i, u in enumerate(urls * 3):
        r, best = got[i], (-1, None, "allow")
        for verdict, h, p in rules:
            if h and (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p) and (len(h + p), verdict == "block") >= (best[0], best[2] == "block"):
                best = (len(h + p), h + p, verdict)
        assert (r["rule"], r["verdict"]) == best[1:], u
    assert urlrange.judge(pages.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0
    assert urlrange.judge(pages, spark.createDataFrame([], "verdict string, host string, path string")).where("verdict = 'allow' AND rule IS NULL").count() == len(urls) * 3


def test_urls_of_a_hot_host(spark):
    """A host with most pages owns several ranges; pages without an id and repeated ones are judged like any other."""
    rows = [(None if i % 3 == 0 else i % 700, f"http://{'hot.net' if i % 10 else f'h{i}.org'}/p{i % 40}") for i in range(3000)]
    rules = spark.createDataFrame([("block", "hot.net", "/p1"), ("allow", "net", "/p1"), ("block", "org", "/p2")], "verdict string, host string, path string")
    got = Counter(map(tuple, urlrange.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()))
    want = Counter()
    for i, u in rows:
        host, path = u[7:].split("/", 1)
        path = "/" + path
        rule = "hot.net/p1" if host == "hot.net" and path.startswith("/p1") else "org/p2" if host.endswith("org") and path.startswith("/p2") else None
        want[i, host, path, rule, "block" if rule else "allow"] += 1
    assert got == want
    for k in range(40):
        keys = sorted(str(x) for x in range(k))
        df = spark.createDataFrame([(x,) for x in ["", "0", "17", "3", "39", "9", "zz"]], "k string")
        at = df.select("k", urlrange._place(keys, lambda b: b < F.col("k")).alias("n")).collect()
        assert all(r["n"] == sum(x < r["k"] for x in keys) for r in at)


# ---- op7


def brute_components(fps):
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            parent[find(i)] = find(int(j))
    return [find(i) for i in range(len(a))]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(spark, docs, empty):
    for table in (spark.read.parquet(f"{SF}/documents.parquet"), docs.where("doc_id IS NOT NULL AND doc_id <> 9")):
        rows = table.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r[1]) for r in rows]
        roots, first = brute_components(fps), {}
        for r, root in zip(rows, roots, strict=True):
            first[root] = min(first.get(root, 1 << 60), r[0])
        want = sorted((r[0], f"{fp:016x}", first[root]) for r, fp, root in zip(rows, fps, roots, strict=True))
        assert sorted(map(tuple, simhash.near_duplicates(table).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.unique(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]


@pytest.mark.parametrize("run", [4, 16_384])
def test_links_of_dense_groups(spark, run):
    rng, fps = random.Random(2), set()
    for _ in range(15):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    of = {int(np.uint64(x).view(np.int64)): r for x, r in zip(fps, brute_components(fps), strict=True)}
    df = spark.createDataFrame([(x,) for x in of], "fp long")
    roots = {r[0]: r[1] for r in components.components(simhash.links(df, run)).collect()}
    groups = lambda name: sorted(tuple(sorted(g)) for g in _by(of, name).values())
    assert groups(lambda x: roots.get(x, x)) == groups(of.__getitem__)


def _by(items, name):
    out = {}
    for x in items:
        out.setdefault(name(x), []).append(x)
    return out


def test_components_of_a_path(spark):
    n = 50
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components.components(links).collect()} == {(i, 0) for i in range(1, n + 1)}


# ---- op8


def test_mixing_equals_sql(spark, docs, empty):
    as_sql(mixing.mixing_quotas(spark, SF), mixing.QUOTAS_SQL)
    some = docs.where("doc_id IS NOT NULL")
    as_sql(mixing.mix(some).drop("draws"), mixing.QUOTAS_SQL, documents=some.select("doc_id", "text", "source").toArrow())
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mixing_draws(spark):
    out = mixing.op8_mixing(spark, SF).collect()
    again = {r["doc_id"]: r for r in mixing.op8_mixing(spark, SF).collect()}
    for r in out:
        assert r["taken"] == sum(d["words"] for d in r["draws"]) <= 2 * r["size"] and again[r["doc_id"]] == r
    shards = Counter(d["shard"] for r in out for d in r["draws"])
    assert len(shards) > 32
    tree = mixing.split_tree([100, 3, 0, 50], 8)
    assert tree.sum(axis=0).tolist() == [100, 3, 0, 50] and set(tree.sum(axis=1)) <= {19, 20}
    draws = np.array([mixing.split_tree([60, 40], 2, seed)[0, 0] for seed in range(300)])
    assert abs(draws.mean() - 30) < 1 and draws.std() > 1


def test_mixed_documents(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    got = Counter(r[0] for r in mixed.select("doc_id").collect())
    assert max(got.values()) == 2
    sums = mixing.mix(table).select("doc_id", "source_size", "target", "size").collect()
    by_source = {}
    for r in sums:
        have = by_source.setdefault((r["source_size"], r["target"]), [0, 0])
        have[0] += got[r["doc_id"]] * r["size"]
        have[1] = max(have[1], r["size"])
    assert all(abs(t - x) <= biggest for (_, t), (x, biggest) in by_source.items())
    assert mixing.mixed_documents(docs).columns == docs.columns
    # rows that share an id are drawn one by one, equal rows as often as together
    rows = [(7, f"{'word ' * (i + 1)}", "abcdefg"[i % 7]) for i in range(60)] + [(1, "equal text", "a")] * 5 + [(None, "no id", None)] * 3
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(some).collect())
    for r in mixing.mix(some, whole_documents=True, row_key=F.xxhash64("doc_id", "text", "source")).collect():
        want[r["doc_id"], r["size"]] += len(r["draws"])
    assert Counter({k: n for k, n in want.items() if n}) == sum((Counter({(i, len(t.split())): n}) for (i, t), n in got.items()), Counter())


def test_mixing_many_sources(spark):
    """More sources than are broadcast: the same plan."""
    rows = [(i, "w " * (i % 9), f"s{i % 300:03d}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(tuple, mixing.mix(df, sent=10).collect())) == sorted(map(tuple, mixing.mix(df).collect()))


# ---- op9, op10


def test_rans_blocks():
    rng = np.random.default_rng(0)
    for n in (1, 2, 300, 50_000):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint16)
        table = rans.Table(rans.scaled(np.bincount(ids, minlength=1 << 16)))
        raw = rans.segment_bytes([1, None], [n - 1, 1], ids, table)
        names, counts, got = rans.read_segment(raw, table)
        assert names == [1, None] and counts.tolist() == [n - 1, 1] and (got == ids).all()
        damaged = raw[:-4] + bytes(4) if raw[-4:] != bytes(4) else raw[:-4] + b"abcd"
        with pytest.raises(ValueError):
            rans.read_segment(damaged, table)
    flat = rans.scaled(np.ones(1 << 16, np.int64))
    assert flat.sum() == 1 << rans.PRECISION and flat.min() >= 1
    skewed = rans.scaled(np.array([10**12, *[1] * 50_000]))
    assert skewed.sum() == 1 << rans.PRECISION and skewed.min() == 1


def test_rans_equals_library(spark, docs, empty, library):
    for table in (spark.read.parquet(f"{SF}/documents.parquet"), docs):
        rows = sorted(((r[0] if r[0] is not None else -1, r[1] or "") for r in table.select("doc_id", "text").collect()), key=lambda r: r[0])
        at, want = 0, []
        for i, text in rows:
            ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
            want.append((i if i >= 0 else None, at, ids.tobytes()))
            at += len(ids)
        got = [(r[0], r[1], bytes(r[2])) for r in rans.read(rans.write(table)).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()]
        assert got == want
    assert rans.read(rans.write(empty)).count() == 0


def test_rans_folder_stands_alone(spark, docs):
    """Another session decodes from the folder's path alone."""
    made = rans.write(docs)
    want = sorted(map(repr, rans.read(made).collect()))
    other = spark.newSession()
    assert sorted(map(repr, rans.read(rans.Files(other, made.path)).collect())) == want


ALPHABET = "ab \n\t  é'sßñ0123.,! \u3000\x1c\x85\u200bЖ漢字😀\r"


def test_automaton_equals_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["<|endoftext|>a <|endoftext|> b", "  a", "a  ", "a" * 3000, " " * 100, "\x00\x01", "they'll I'd 's", "\n <|endoftext|> x", ""]
    automaton = bpe.compile_file(open(bpe.default_path(), encoding="utf-8").read())
    encoder = bpe.Encoder(automaton)
    column = encoder.encode(pa.array([*texts, None]))
    for text, ids, back in zip([*texts, ""], column.to_pylist(), encoder.decode(column).to_pylist(), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)
    for w, _ in library.pre_tokenizer.pre_tokenize_str(texts[0] + " interesting words" + "x" * 70):
        raw = bytes(bpe.byte_letters()[c] for c in w)
        assert automaton.word(raw) == library.encode(raw.decode(), add_special_tokens=False).ids
    half = library.encode("😀", add_special_tokens=False).ids[:1]  # a cut character
    assert encoder.decode(presplit.packed(np.array(half, np.uint32), np.array([1]))).to_pylist() == [library.decode(half, skip_special_tokens=False)]


def test_presplit_equals_library(library):
    """Words of random texts, and around every code point."""
    letters = bpe.byte_letters()
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET + "'rvelmtds' '") for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += [f"a{chr(c)}1" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3500 or c % 7 == 0)] + ["", "it's", "'re", "'r", "''s", "\n's", "it'"]
    words = presplit.Words(pa.array(texts))
    known, at = words.distinct.to_pylist(), 0
    for t, n in zip(texts, words.counts.tolist(), strict=True):
        got = [known[i] for i in words.number[at : at + n]]
        assert got == [bytes(letters[c] for c in w) for w, _ in library.pre_tokenizer.pre_tokenize_str(t)], t
        at += n


def test_two_vocabularies_in_one_session(spark, docs, library):
    """Workers are reused; each frame meets its own tables."""
    import json
    import tempfile

    with open(bpe.default_path(), encoding="utf-8") as f:
        model = json.load(f)
    names = sorted(model["model"]["vocab"], key=model["model"]["vocab"].get)
    few = {n: i for i, n in enumerate(n for n in names if len(n) == 1)}
    wide = {n: i + 70_000 for n, i in few.items()}  # ids that don't fit 16 bits
    for vocabulary in (few, wide):
        small = {**model, "added_tokens": [], "model": {**model["model"], "vocab": vocabulary, "merges": []}}
        with tempfile.NamedTemporaryFile("w", suffix=".json", dir="/tmp", delete=False, encoding="utf-8") as f:
            json.dump(small, f)
        low = min(vocabulary.values())
        have = {r[0]: r for r in bpe.Tokenizer(spark, f.name).round_trip(docs.where("doc_id = 8")).collect()}
        ids = np.frombuffer(have[8]["ids"], "<u4")
        letters = bpe.byte_letters()
        assert [vocabulary[{b: c for c, b in letters.items()}[x]] for x in have[8]["text"].encode()] == ids.tolist()
        files = rans.write(docs.where("doc_id = 8"), f.name, end_id=low)
        assert np.frombuffer(rans.read(files).first()["ids"], "<u4").tolist() == [*ids.tolist(), low]
        with pytest.raises(ValueError):
            rans.write(docs, f.name, end_id=80_000)
    want = library.encode(have[8]["text"], add_special_tokens=False).ids
    assert np.frombuffer(bpe.Tokenizer(spark).encode(docs.where("doc_id = 8")).first()["ids"], "<u4").tolist() == want
    assert np.frombuffer(rans.read(rans.write(docs.where("doc_id = 8"))).first()["ids"], "<u4").tolist() == [*want, 0]


def test_automaton_of_small_merges():
    """Every word over a small alphabet, against merging step by step."""
    letters = {bytes([c]): i for i, c in enumerate(b"abc")}
    merges = [("a", "b"), ("b", "c"), ("ab", "c"), ("a", "a"), ("aa", "b"), ("c", "ab"), ("a", "ab"), ("aa", "aa"), ("cab", "bc")]  # aab is made twice
    vocabulary, ranked = dict(letters), []
    for a, b in merges:
        vocabulary.setdefault((a + b).encode(), len(vocabulary))
        ranked.append((vocabulary[a.encode()], vocabulary[b.encode()], vocabulary[(a + b).encode()]))
    automaton = bpe.Automaton(vocabulary, ranked, {})
    ranks, each = {(a, b): i for i, (a, b, _) in enumerate(ranked)}, []
    for n in range(1, 8):
        for w in itertools.product(b"abc", repeat=n):
            ids = [letters[bytes([c])] for c in w]
            while pairs := [(ranks[p], i) for i, p in enumerate(itertools.pairwise(ids)) if p in ranks]:
                rank, i = min(pairs)
                ids[i : i + 2] = [ranked[rank][2]]
            assert automaton.word(bytes(w)) == ids, bytes(w)
            each.append((bytes(w), ids))
    got, sizes = bpe.Walker(automaton).words(pa.array([w for w, _ in each], pa.large_binary()))
    assert [x.tolist() for x in np.split(got, np.cumsum(sizes)[:-1])] == [ids for _, ids in each]


def test_round_trip(spark, docs, empty, library):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs).collect())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want) and bpe.round_trip(empty).count() == 0
