"""Hand-computed cases of counts, events, merges, roll-ups, pages and streams."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text
from tallyloom.operators import ordering, series
from tallyloom.plans import matching_queries, observations, relational
from tallyloom.plans.adapter import Views
from tallyloom.sources import stores

SF = "/root/testdata/sf0.001"


def run(spark, name, **tables):
    made = {n: spark.createDataFrame(rows, schema) for n, (rows, schema) in tables.items()}
    return [r.asDict() for r in Views(spark, SF).sql(relational.TEXTS[name], **made).collect()]


# ---- round counts


def test_round_counts(spark):
    seen = "round_id long, shop long, offer long, sku long, attempt long, status string, price double, l_orderkey long, seen_at string"
    row = lambda offer, sku, status: (1, 1, offer, sku, 1, status, 1.0, 1, "x")
    snapshots = ([row(10, 1, "success"), row(10, 2, "success"), row(11, 1, "skipped"), row(12, 1, "failed"), row(99, 1, "success")], seen)
    offers = ([(1, 1, o) for o in (10, 11, 12, 13)], "round_id long, shop long, offer long")
    got = run(spark, "round_tally", snapshots=snapshots, shop_offers=offers)
    assert got == [{"round_id": 1, "shop": 1, "discovered": 4, "handled": 2, "failed": 2, "success_offers": 1, "success_skus": 2, "orphans": 1}]
    assert run(spark, "round_totals", snapshots=snapshots, shop_offers=offers) == [{"round_id": 1, "offers": 4, "handled": 2}]
    rounds = ([(1, 1, 3)], "round_id long, shop long, declared long")
    assert run(spark, "declared_mismatch", shop_offers=([(1, 1, 10)], offers[1]), shop_rounds=rounds) == [{"round_id": 1, "shop": 1, "declared": 3, "listed": 1}]
    clicks = ([(1, 1, "a", "click_deny", "idx=1"), (2, 1, "a", "click_no_popup", "idx=2"), (3, 1, "a", "click_ok", "idx=2"), (4, 1, "a", "click_parse_error", "idx=3"), (5, 1, "a", "click_deny", "no place")], "id long, round_id long, shop string, event string, note string")
    assert run(spark, "click_failures", click_log=clicks) == [{"round_id": 1, "failed_cards": 2}]
    rate = run(spark, "failure_rate", snapshots=snapshots, shop_offers=offers, click_log=clicks)
    assert rate == [{"round_id": 1, "attempted": 6, "failed": 4, "failure_rate": pytest.approx(4 / 6, abs=1e-6), "over_limit": True}]


def test_scope_is_the_whole_set(spark):
    rounds = ([(1, s, 0) for s in (1, 2, 4)] + [(2, s, 0) for s in (1, 3, 4)] + [(3, s, 0) for s in (4, 2, 1)], "round_id long, shop long, declared long")
    assert {(r["scope"], r["first_round"], r["last_round"]) for r in run(spark, "round_scope", shop_rounds=rounds)} == {("1,2,4", 1, 3), ("1,3,4", 2, 2)}


# ---- events

LOG = "id long, round_id long, shop string, event string, phase string, ts timestamp_ntz, note string, user_id long"


def log(*events):
    import datetime

    start = datetime.datetime(2026, 9, 16, 1)
    return ([(i, 1, shop, event, "detail", start + datetime.timedelta(milliseconds=ms), "", 0) for i, (shop, event, ms) in enumerate(events, 1)], LOG)


def test_deny_boundary(spark):
    of = lambda *e: {r["shop"]: r["denies"] for r in run(spark, "deny_counts", event_log=log(*((s, x, i) for i, (s, x) in enumerate(e))))}
    assert of(*[("A", "click_deny")] * 3) == {"A": 3}
    assert of(("A", "click_deny"), ("A", "deny_hit"), ("A", "click_deny")) == {"A": 2}
    assert of(("A", "click_deny"), ("A", "deny_hit"), ("A", "click_deny"), ("A", "deny_hit")) == {"A": 3}
    assert of(("A05", "click_deny"), ("A06", "click_deny"), ("A05", "deny_hit"), ("A06", "click_deny"), ("A06", "deny_hit")) == {"A05": 2, "A06": 2}


def test_delays(spark):
    verify = "verification_appear"
    events = [("A", "visit", 0), ("A", "visit", 300), ("A", verify, 400), ("B", "visit", 0), ("B", "visit", 400), ("B", verify, 9000)]
    events += [("C", "visit", 0), ("C", "visit", 1100), ("C", "visit", 2300), ("C", "visit", 3800), ("C", "visit", 4000)]
    got = {r["bin"]: (r["events"], r["triggers"], r["rate"]) for r in run(spark, "interval_histogram", event_log=log(*events))}
    assert got["<0.5s"] == (2, 2, 1.0) and got["1-2s"] == (3, 0, 0.0) and got[">=60s"] == (0, 0, None) and len(got) == 7
    both = run(spark, "delay_correlation", event_log=log(*events))[0]
    assert both["n"] == 5 and both["pearson"] < 0 and both["spearman"] < 0
    nothing = {r["events"] for r in run(spark, "interval_histogram", event_log=([], LOG))}
    assert nothing == {0} and run(spark, "delay_correlation", event_log=([], LOG)) == []


def test_visits_since_pause(spark):
    import datetime

    at = lambda h, m: datetime.datetime(2026, 9, 16, h, m)
    rows = [(1, 1, "pacing_visit", at(9, 0)), (2, 1, "pause", at(9, 1)), (3, 1, "pacing_visit", at(9, 2)), (4, 1, "resume", at(9, 3)), (5, 1, "pacing_visit", at(9, 4)), (6, 1, "pacing_visit", at(9, 5))]
    table = lambda end: ([(*r, end) for r in rows], "id long, round_id long, event string, ts timestamp_ntz, day_end timestamp_ntz")
    assert run(spark, "visits_since_pause", pacing_log=table(at(9, 30))) == [{"round_id": 1, "visits": 2, "idle_ms": 25 * 60_000, "idle_reset": False}]
    assert run(spark, "visits_since_pause", pacing_log=table(at(10, 5))) == [{"round_id": 1, "visits": 0, "idle_ms": 60 * 60_000, "idle_reset": True}]


# ---- merge of sources

WORLD = "machine string, shop string, offer string, sku string, date string, observed_at string, observed long, stock long"


@pytest.mark.parametrize("turned", [False, True])
def test_merge(spark, turned):
    row = lambda m, offer, sku, at, stock: (m, "A01", offer, sku, "2026-09-16", at, 1, stock)
    early, late = "2026-09-16T09:00", "2026-09-16T10:00"
    rows = [row("m1", "11", "a", early, 10), row("m1", "11", "b", early, 20), row("m2", "11", "a", late, 30), row("m2", "11", "c", late, 40)]
    rows += [row("m1", "12", "default", early, 1), row("m2", "12", "x", late, 2), row("m2", "12", "y", late, 3)]
    rows = rows[::-1] if turned else rows
    got = {(r["offer"], r["sku"]): (r["machine"], r["stock"]) for r in run(spark, "merged_inventory", machine_inventory=(rows, WORLD))}
    assert got == {("11", "a"): ("m2", 30), ("11", "b"): ("m1", 20), ("11", "c"): ("m2", 40), ("12", "x"): ("m2", 2), ("12", "y"): ("m2", 3)}
    tie = [row("m1", "11", "a", late, 10), row("m2", "11", "a", late, 30)]
    assert [(r["machine"], r["stock"]) for r in run(spark, "merged_inventory", machine_inventory=(tie, WORLD))] == [("m2", 30)]
    assert run(spark, "merge_conflicts", machine_inventory=(rows, WORLD)) == [{"shop": "A01", "date": "2026-09-16", "winner": "m2", "loser": "m1", "n": 3, "replaced": 1, "kept": 2}]
    assert {r["machine"] for r in run(spark, "owned_rows", machine_inventory=(rows, WORLD))} == {"m2"}  # its claim is the latest observation
    digest = lambda some: {r["machine"]: (r["n"], r["part1"], r["part2"], r["part3"]) for r in run(spark, "table_digest", machine_inventory=(some, WORLD))}
    changed = [*rows[:2], (*rows[2][:7], 99), *rows[3:]]
    assert digest(rows) == digest(rows[::-1]) != digest(changed)


# ---- roll-ups and orders


def test_roll_up(spark):
    rows = [("A", "o", 1, None, 0, "green"), ("A", "o", 1, 5, 2, "red"), ("A", "p", 1, None, 0, "yellow"), ("A", "p", 1, None, 1, "green")]
    df = spark.createDataFrame(rows, "shop string, offer string, date int, stock long, sales long, color string")
    got = {r["offer"]: (r["stock"], r["sales"], r["color"]) for r in series.roll_up(df, "shop", "offer").collect()}
    assert got == {"o": (5, 2, "red"), "p": (None, 1, "green")}
    groups = spark.createDataFrame([(1, 20), (2, 70), (3, 20)], "id long, sales long")
    assert [r["id"] for r in series.rank(groups, F.desc("sales"), "id").orderBy("rank").collect()] == [2, 1, 3]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = sorted((r["rn"], r["x"]) for r in ordering.numbered(df, F.desc("x")).collect())
    assert [n for n, _ in got] == list(range(1, 1001)) and [x for _, x in got] == sorted((x for _, x in got), reverse=True)
    assert ordering.numbered(df.limit(0), "x").count() == 0


# ---- pages


def found(spark, html):
    return [r.asDict() for r in spark.createDataFrame([(html,)], "h string").select(F.inline(text.skus(F.col("h")))).collect()]


def test_skus_of_the_map(spark):
    html = """x "skuProps":[{"value":[{"name":"red #C1#","imageUrl":" //r.jpg "},{"name":"","imageUrl":"u"},7]},"odd"], "skuInfoMap": {"k1":{"specAttrs":"red #C1#&gt;L {","skuId":5,"discountPrice":0,"canBookCount":"64.8万"},
      "k2":{"price":"-3","quantity":"1,234"}}, "later":{"a":1}}"""
    a, b = found(spark, html)
    assert (a["sku_id"], a["id_source"], a["name"], a["price"], a["stock"], a["picture"], a["complete"]) == ("5", "platform", "red #C1#&gt;L {", 0.0, 648_000, "//r.jpg", True)
    assert (b["id_source"], b["name"], b["price"], b["stock"], b["picture"]) == ("derived", "k2", None, 1234, None) and len(b["sku_id"]) == 16
    part = found(spark, '"skuInfoMap":{"a":{"skuId":1,"price":1,"quantity":1},"b":[]}')
    assert [(r["sku_id"], r["complete"]) for r in part] == [("1", False)]


def test_skus_otherwise(spark):
    lines = found(spark, "<p>small#C0615# ¥0.18 库存 6486515个</p><p>big ￥0.03 库存:747,155</p><p>big ￥0.03 库存:747,155</p>")
    assert [(r["name"], r["price"], r["stock"], r["complete"]) for r in lines] == [("small#C0615#", 0.18, 6486515, False), ("big", 0.03, 747155, False)]
    lone = '"isSkuOffer":false,"skuInfoMap":[],"tradeModel":{"offerPriceModel":{"currentPrices":[{"price":"2.5"}]},"canBookedAmount":7}'
    assert [(r["sku_id"], r["price"], r["stock"], r["complete"]) for r in found(spark, lone)] == [("default", 2.5, 7, True)]
    for odd in (lone.replace("false,", 'false,"isSkuOffer":true,', 1), lone + '"skuTradeSupported":true', lone.replace('"canBookedAmount":7', '"x":1'), "", "<html>", None):
        assert found(spark, odd) == []


def test_links_titles_pictures(spark):
    html = '<meta property="og:title" content="<b>A</b> &amp; B"><title>no</title><a href="/offer/7.html?a=1&amp;b">x</a><a href=\'/item/8.html\'>y</a><a href="/offer/7.html">z</a><a href="/other/9.html">'
    df = spark.createDataFrame([(html,)], "h string").select(text.title(F.col("h")).alias("t"), text.offer_links(F.col("h")).alias("l"), text.main_picture(F.lit('"mainImage":["https:\\/\\/i\\/a.jpg"]')).alias("p"))
    r = df.first()
    assert r["t"] == "A & B" and [(x["offer"], x["url"]) for x in r["l"]] == [("7", "/offer/7.html?a=1&b"), ("8", "/item/8.html")] and r["p"] == "https://i/a.jpg"


# ---- stores


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gbk"])
def test_lists_in_any_encoding(spark, tmp_path, encoding):
    (tmp_path / "shops.csv").write_bytes("编号,name\n1,杯子店\n2,b\n".encode(encoding))
    df = stores.read_list(spark, str(tmp_path))
    assert df.columns == ["编号", "name"] and sorted(map(tuple, df.collect())) == [("1", "杯子店"), ("2", "b")]


def test_damaged_packages_and_plans(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    df.write.parquet(f"{tmp_path}/all/p1")
    (tmp_path / "all" / "broken.parquet").write_bytes(b"PAR1 cut")
    rows, failures = stores.scan(spark, f"{tmp_path}/all", T.StructType([T.StructField("x", T.LongType()), T.StructField("z", T.StringType())]))
    assert [tuple(r) for r in rows.collect()] == [(1, None)] and [r["path"].rsplit("/", 1)[1] for r in failures.collect()] == ["broken.parquet"]
    stores.commit_version(df, f"{tmp_path}/d")
    stores.commit_version(df.withColumn("x", F.lit(2)), f"{tmp_path}/d")
    assert [r["x"] for r in stores.current(spark, f"{tmp_path}/d").collect()] == [2]
    (tmp_path / "plans").mkdir()
    shop = '{"shop":1,"pages":2,"machine":"m1"}'
    docs = [f'{{"week":"2026-W01","machines":["m1"],"shops":[{shop}]}}', f'{{"machines":["m1"],"shops":[{shop}]}}', f'{{"week":"2026-W02","machines":["m2"],"shops":[{shop}]}}', f'{{"week":"2026-W03","machines":["m1"],"shops":[{shop},{shop}]}}', "{nonsense"]
    (tmp_path / "plans" / "p.json").write_text("\n".join(docs))
    assert {(r["week"], r["problem"]) for r in stores.read_plans(spark, f"{tmp_path}/plans").collect()} == {("2026-W01", None), (None, "no week"), ("2026-W02", "unknown machine"), ("2026-W03", "repeated shop"), (None, "unreadable")}


# ---- streams


def test_stream_equals_batch(spark):
    v = Views(spark, SF)
    batch = {tuple(r) for r in v.sql(relational.TEXTS["deny_window"]).select("id", "shop", "in_window").collect()}
    assert {tuple(r) for r in matching_queries.QUERIES["stream_deny_window"](v).select("id", "shop", "in_window").collect()} == batch


def test_texts_differ():
    """A query's SQL is not its Spark text with other functions."""
    assert all(a != b for a, b in observations.TEXTS.values())
