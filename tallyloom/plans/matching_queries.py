"""Matching, text, plan and streaming queries, and the SQL of those that have one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import matching, nearest, planning
from tallyloom.plans import shared
from tallyloom.plans.adapter import Views, duck
from tallyloom.plans.shared import cut as _cut
from tallyloom.sources import packages
from tallyloom.streaming import events


def _items(v: Views) -> DataFrame:
    """Products with the tokens of their names and, where there is one, of their pictures. They are dealt to all tasks once, before the tokens
    make them long: recall works on each item where it lies, and a small file is one task. They lie by name and picture, so that those alike are
    looked up once; a name that many have is still dealt to several tasks."""
    n = int(v.spark.conf.get("spark.sql.shuffle.partitions"))
    products = v["products"].select("ordinal", "shop", "offer", "name", "image")
    products = _cut(products.repartitionByRange(n, "name", "image", "ordinal").sortWithinPartitions("name", "image", "ordinal"))
    pictures = v["embeddings"].select(F.col("vec_id").alias("image"), matching.image_tokens(F.col("embedding")).alias("_seen"))
    rows = products.join(pictures, "image", "left").withColumn("identity", F.concat_ws("/", "shop", "offer"))
    return rows.withColumn("tokens", F.concat(matching.name_tokens(F.col("name")), F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")


def _versions(v: Views) -> DataFrame:
    return v["products"].select("ordinal", matching.evidence_version(F.col("name"), F.col("image")).alias("version"))


def _edges(v: Views) -> DataFrame:
    return matching.judged(matching.recall(_items(v)))


def _whole(v: Views) -> DataFrame:
    """The same from all holders of a token, however many they are."""
    return matching.judged(nearest.pairs(_items(v), k=matching.K))


def _valid(edges: DataFrame) -> DataFrame:
    """Judged under one signature, the others don't count."""
    return edges.withColumn("signature", F.when(F.pmod(F.col("a") + F.col("b"), F.lit(9)) == 0, "old").otherwise("now")).where("signature = 'now'")


def _kept(edges: DataFrame, versions: DataFrame) -> DataFrame:
    """Judgments, kept by versions."""
    of = lambda x, n: versions.select(F.col("ordinal").alias(x), F.col("version").alias(n))
    return edges.join(of("a", "va"), "a").join(of("b", "vb"), "b")


def _judgments(v: Views) -> DataFrame:
    return _kept(_valid(_edges(v)), _versions(v))


def _positives(v: Views, edges: DataFrame) -> DataFrame:
    """a, b, va, vb of the positive ones; the items' versions stay where they lie if these are few."""
    rows = shared.few(edges.where("positive").select("a", "b"))
    for end in ("a", "b"):
        rows = shared.few(rows.join(_versions(v).select(F.col("ordinal").alias(end), F.col("version").alias(f"v{end}")), end))
    return rows


def _near(v: Views, edges: DataFrame | None = None) -> DataFrame:
    """va, vb, positive: judgments by versions, of those versions that have a positive one. Others lie in no component of such, so their pairs
    are left out by the items' numbers, before versions are put to them."""
    edges = _cut(_valid(_edges(v) if edges is None else edges).select("a", "b", "positive"))
    good = _positives(v, edges)
    ends = shared.few(good.select(F.col("va").alias("version")).union(good.select("vb")).distinct())
    rows = _kept(edges, shared.few(_versions(v).join(ends, "version", "left_semi")))
    return _cut(rows.groupBy(F.least("va", "vb").alias("va"), F.greatest("va", "vb").alias("vb")).agg(F.max("positive").alias("positive")))


def _clusters(v: Views) -> tuple[DataFrame, DataFrame]:
    edges = _cut(_whole(v))
    return edges, matching.clusters(v["products"], edges, _cut)


def _constrained(v: Views) -> tuple[DataFrame, DataFrame]:
    """Confirmed groups: products of one picture among those of low numbers; excluded: neighbours of a shop."""
    p = v["products"]
    frozen = p.where("image < 20").select("ordinal", F.concat(F.lit("M"), F.col("image").cast("string")).alias("group"))
    excluded = p.select(F.col("ordinal").alias("a"), (F.col("ordinal") + 12).alias("b")).where("a % 5 = 0")
    return frozen, matching.assemble(_versions(v), _near(v, _whole(v)), _cut, frozen, excluded)


def _group_ids(v: Views) -> DataFrame:
    frozen, placed = _constrained(v)
    placed = _cut(placed)
    return matching.named(placed, frozen.select(F.col("group").alias("group_id"), "ordinal"), _cut).join(placed, "cluster").select("ordinal", "group_id")


def _images(v: Views) -> DataFrame:
    return v["embeddings"].select("vec_id", F.explode(matching.image_tokens(F.col("embedding"))).alias("token"))


def _amounts(v: Views) -> DataFrame:
    return v["events"].select("event_id", F.concat(F.lit("x "), F.format_number("value", 2)).alias("raw"))


def _planned(v: Views) -> DataFrame:
    """Week 5 of each region after the weeks before; shops of one nation are a region."""
    nation = v["supplier"].select(F.col("s_suppkey").alias("shop"), F.col("s_nationkey").cast("long").alias("region"))
    past = v["weekly_plan"].join(nation, "shop")
    return planning.weekly_plan(past.where("week = 4").select("region", "shop", "pages"), past, ["m1", "m2", "m3"], 5)


def _streamed(v: Views, key: str, last: str, ends_ms: int | None) -> DataFrame:
    """The event log as a stream of files that overlap in time by up to fifty minutes, stopped after the third and begun again.
    key: what denials are counted by; last: a row that comes at the end, if any."""
    work = lambda stream: events.round_denies(stream, ends_ms=ends_ms)
    root, log = f"{shared.folder(v.spark)}/log-{uuid.uuid4().hex}", shared.cut(v.sql(_STREAMED.replace("KEY", key).replace("LAST", last)))
    schema, out, number = log.schema, f"{root}-out", F.col("file")
    events.chunked(v.spark, log, f"{root}/in", number, 0, 2)
    events.resumed(v.spark, f"{root}/in", schema, work, out)
    events.chunked(v.spark, log, f"{root}/in", number, 3, 6 if last else 5)
    return events.resumed(v.spark, f"{root}/in", schema, work, out)


#: Files by time, each row up to fifty minutes late.
_STREAMED = """SELECT event_id AS id, CAST(KEY AS BIGINT) AS round_id, 'S' || CAST(user_id % 12 AS STRING) AS shop, CAST(ts AS TIMESTAMP) AS at, EPOCHMS(ts) AS ms, event_type IN ('signup', 'purchase') AS denied,
  least(5, CAST(floor(6.0 * (EPOCHMS(ts) - low + event_id % 50 * 60000) / (high - low + 1)) AS BIGINT)) AS file
FROM {events} JOIN (SELECT min(EPOCHMS(ts)) AS low, max(EPOCHMS(ts)) AS high FROM {events}) m ON true LAST"""
#: Lets the watermark pass all rows before it, and is held back itself.
_LAST = "UNION ALL SELECT -1, -1, '', max(CAST(ts AS TIMESTAMP)) + INTERVAL '1' DAY, max(EPOCHMS(ts)) + 86400000, true, 6 FROM {events}"

QUERIES = {
    "name_tokens": lambda v: v["products"].select("ordinal", F.explode(matching.name_tokens(F.col("name"))).alias("token")),
    "image_tokens": _images,
    "recall_pairs": lambda v: matching.recall(_items(v)),
    "judged_edges": _edges,
    "score_curve": lambda v: _whole(v).groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("positives")),
    "positive_components": lambda v: matching.components(_whole(v).where("positive"), _cut),
    "style_clusters": lambda v: _clusters(v)[1],
    "candidate_labels": lambda v: matching.candidates(*_clusters(v), _cut),
    "cluster_replay": lambda v: matching.replay(*_clusters(v), _cut),
    "pair_keys": lambda v: _judgments(v).select("a", "b", matching.pair_key(F.col("va"), F.col("vb")).alias("pair_key")),
    "version_edges": lambda v: matching.spread_edges(_judgments(v).select("va", "vb", "positive").distinct(), _versions(v)),
    "constrained_groups": lambda v: _constrained(v)[1],
    "group_names": _group_ids,
    "page_titles": lambda v: v["pages"].select("page_id", text.title(F.col("html")).alias("title")),
    "page_links": lambda v: v["pages"].select("page_id", F.posexplode(text.links(F.col("html"))).alias("nth", "link")),
    "prices": lambda v: _amounts(v).select("event_id", text.price(F.col("raw")).alias("price")),
    "stock_counts": lambda v: _amounts(v).select("event_id", text.stock(F.concat("raw", F.lit("万"))).alias("stock")),
    "merchant_codes": lambda v: v["orders"].select("o_orderkey", F.array_join(text.codes(F.concat(F.lit("x # c-"), F.pmod("o_custkey", F.lit(50)).cast("string"), F.lit(" # y #"), F.col("o_orderpriority"), F.lit("#"))), ",").alias("codes")),
    "page_kinds": lambda v: v["pages"].select("page_id", text.page_kind(F.col("url")).alias("kind")),
    "asset_keys": lambda v: v["pages"].select("page_id", text.asset_key(F.sha2("html", 256), F.lit("image/png")).alias("key")),
    "sku_ids": lambda v: v["inventory"].select("offer", "sku").distinct().select("offer", "sku", F.substring(F.sha1(F.concat_ws("|", "offer", "sku")), 1, 16).alias("sku_id")),
    "clocks": lambda v: v["events"].select("event_id", text.clock(F.col("value") * 10).alias("clock")),
    "package_digest": lambda v: packages.digest(v["machine_inventory"].select("machine", "shop", "offer", "sku", "date", "stock")),
    "planned_weeks": _planned,
    "stream_deny_windows": lambda v: events.completed(events.deny_windows(events.source(v.spark, v.sf_dir, "events"))),
    "clique_groups": lambda v: matching.clique_groups(_versions(v), _positives(v, _valid(_whole(v))), _cut),
    "stream_deny_window": lambda v: _streamed(v, "user_id % 12", _LAST, None).select("id", "shop", "in_window", "sets_off"),
    "stream_round_denies": lambda v: _streamed(v, "day(ts)", "", 86_400_000),
    "stream_first_seen": lambda v: events.finished(events.first_seen(events.source(v.spark, v.sf_dir, "events"))),
}

_TOKENS = r"""tok AS (SELECT DISTINCT ordinal, 't:' || substr(bare, CAST(i AS INT), 2) AS token FROM (SELECT ordinal, bare, unnest(generate_series(1, length(bare) - 1)) AS i FROM (
  SELECT ordinal, lower(regexp_replace(name, '[^\pL\pN]', '', 'g')) AS bare FROM {products}) WHERE length(bare) > 1))"""
_SEEN = f"""{_TOKENS},
pic AS (SELECT vec_id, embedding AS e, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean FROM {{embeddings}}),
seen AS (SELECT ordinal, token FROM tok UNION SELECT ordinal, 'v:' || i || ':' || array_to_string(list_transform(e[i * 16 + 1:i * 16 + 16], lambda x: CASE WHEN x::DOUBLE >= mean THEN '1' ELSE '0' END), '') FROM {{products}} JOIN pic ON vec_id = image, (SELECT unnest([0, 1, 2, 3]) AS i))"""
_CAPPED = """held AS (SELECT ordinal, token, row_number() OVER (PARTITION BY token ORDER BY ordinal) AS place FROM seen),
capped AS MATERIALIZED (SELECT ordinal, token FROM held WHERE place <= 128),
found AS MATERIALIZED (SELECT s.ordinal AS i, l.ordinal AS j, count(*) AS n FROM held s JOIN capped l ON s.token = l.token AND s.ordinal <> l.ordinal GROUP BY 1, 2)"""
_EVERY = """found AS MATERIALIZED (SELECT s.ordinal AS i, l.ordinal AS j, count(*) AS n FROM seen s JOIN seen l ON s.token = l.token AND s.ordinal <> l.ordinal GROUP BY 1, 2)"""
_SCORED = """pairs AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY n DESC, shop || '/' || offer, j) AS r FROM found JOIN {products} p ON p.ordinal = j) WHERE r <= 6),
recalled AS (SELECT a, b, coalesce(n, 0) AS score FROM pairs LEFT JOIN found ON i = a AND j = b),
edges AS (SELECT *, same AND confidence >= 0.8 AS positive FROM (SELECT *, score >= 8 AS same, ((a * 31 + b * 17) % 100) / 100.0::DOUBLE AS confidence FROM recalled))"""
_PAIRS = f"{_SEEN},\n{_CAPPED},\n{_SCORED}"
#: Lists of tokens whole, for the queries by ``_whole``.
_ALL_PAIRS = f"{_SEEN},\n{_EVERY},\n{_SCORED}"
_JUDGED = """ver AS (SELECT ordinal, sha256('["' || name || '","' || image || '"]') AS version FROM {products}),
judged AS (SELECT a, b, x.version AS va, y.version AS vb, positive FROM edges JOIN ver x ON x.ordinal = a JOIN ver y ON y.ordinal = b WHERE (a + b) % 9 <> 0)"""

SQL = {
    "name_tokens": duck(f"WITH {_TOKENS} SELECT * FROM tok"),
    "image_tokens": """WITH m AS (SELECT vec_id, embedding AS e, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding) AS mean FROM embeddings)
      SELECT vec_id, 'v:' || i || ':' || array_to_string(list_transform(e[i * 16 + 1:i * 16 + 16], lambda x: CASE WHEN x::DOUBLE >= mean THEN '1' ELSE '0' END), '') AS token FROM m, (SELECT unnest([0, 1, 2, 3]) AS i)""",
    "recall_pairs": duck(f"WITH {_PAIRS} SELECT * FROM recalled"),
    "judged_edges": duck(f"WITH {_PAIRS} SELECT * FROM edges"),
    "score_curve": duck(f"WITH {_ALL_PAIRS} SELECT score, count(*) AS n, CAST(sum(CAST(positive AS INT)) AS BIGINT) AS positives FROM edges GROUP BY score"),
    "positive_components": duck(f"""WITH RECURSIVE {_ALL_PAIRS}, u AS (SELECT a, b FROM edges WHERE positive UNION SELECT b, a FROM edges WHERE positive),
      reach(node, other) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM reach r JOIN u ON u.a = r.other) SELECT node, min(other) AS root FROM reach GROUP BY node"""),
    "pair_keys": duck(f"WITH {_PAIRS}, {_JUDGED} SELECT a, b, sha256(least(va, vb) || '|' || greatest(va, vb)) AS pair_key FROM judged"),
    "version_edges": duck(f"WITH {_PAIRS}, {_JUDGED} SELECT least(x.ordinal, y.ordinal) AS a, greatest(x.ordinal, y.ordinal) AS b, bool_or(positive) AS positive FROM judged JOIN ver x ON x.version = va JOIN ver y ON y.version = vb WHERE x.ordinal <> y.ordinal GROUP BY 1, 2"),
    "page_titles": """SELECT page_id, nullif(substr(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '[ ]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&')), 1, 300), '') AS title FROM pages""",
    "page_links": """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages), f AS (SELECT page_id, link, min(i) AS i FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM l) GROUP BY 1, 2)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS nth, link FROM f""",
    "page_kinds": "SELECT page_id, CASE WHEN lower(url) LIKE '%login%' THEN 'login' WHEN lower(url) LIKE '%punish%' THEN 'punish' WHEN lower(url) LIKE '%deny%' THEN 'deny' ELSE 'plain' END AS kind FROM pages",
    "asset_keys": "SELECT page_id, 'img/' || substr(sha256(html), 1, 2) || '/' || sha256(html) || '.png' AS key FROM pages",
    "sku_ids": duck("SELECT DISTINCT offer, sku, substr(sha1(offer || '|' || sku), 1, 16) AS sku_id FROM {inventory}"),
    "merchant_codes": "SELECT o_orderkey, array_to_string(list_sort(list_distinct(['C-' || (o_custkey % 50), upper(o_orderpriority)])), ',') AS codes FROM orders",
    "prices": "SELECT event_id, CAST(round(value, 2) AS DOUBLE) AS price FROM events",
    "stock_counts": "SELECT event_id, CAST(CAST(round(value, 2) AS DECIMAL(18, 2)) * 10000 AS BIGINT) AS stock FROM events",
    "clocks": "SELECT event_id, (s // 3600) || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(floor(value * 10) AS BIGINT) AS s FROM events)",
    "stream_deny_windows": "SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS starts, 'S' || (user_id % 12) AS shop, count(*) AS denies FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2",
    "stream_deny_window": "WITH d AS (SELECT event_id AS id, 'S' || (user_id % 12) AS shop, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('signup', 'purchase')) SELECT a.id, a.shop, count(*) AS in_window, NOT EXISTS (SELECT 1 FROM d c WHERE c.shop = a.shop AND (c.ms, c.id) < (a.ms, a.id)) AS sets_off FROM d a JOIN d b ON b.shop = a.shop AND b.ms BETWEEN a.ms - 7200000 AND a.ms GROUP BY a.id, a.shop, a.ms",
    "stream_round_denies": """WITH e AS (SELECT event_id AS id, day(ts)::BIGINT AS round_id, 'S' || (user_id % 12) AS shop, epoch_us(ts) // 1000 AS ms, event_type IN ('signup', 'purchase') AS denied FROM events),
      d AS (SELECT * FROM e WHERE denied), seen AS (SELECT *, row_number() OVER (PARTITION BY round_id ORDER BY ms, id) = 1 AS sets_off FROM d)
      SELECT a.id, a.round_id, a.shop, count(*) FILTER (b.shop = a.shop) AS in_window, count(*) AS in_round, a.sets_off FROM seen a JOIN d b ON b.round_id = a.round_id AND b.ms BETWEEN a.ms - 7200000 AND a.ms
      WHERE a.ms < (SELECT max(ms) FROM d) - 3600000 GROUP BY a.id, a.round_id, a.shop, a.sets_off""",
    "stream_first_seen": "SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events",
}
