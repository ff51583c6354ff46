"""Round trips through shared storage, edits folded from their log, sets collected from machines: each with SQL that
states what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import matching, series
from tallyloom.plans import shared
from tallyloom.plans.adapter import Views, duck
from tallyloom.plans.matching_queries import _ALL_PAIRS, _PAIRS, _clusters, _edges, _whole
from tallyloom.plans.series_queries import END, START, _chain, _series
from tallyloom.sources import commits, packages, stores


def _root(v: Views, what: str) -> str:
    return f"{shared.folder(v.spark)}/{what}-{uuid.uuid4().hex}"


def package_scan(v: Views) -> DataFrame:
    """Packages of all machines and a damaged one: rows read by machine, and the failure."""
    root, rows = _root(v, "packages"), v["machine_inventory"].select("machine", "shop", "offer", "sku", "date", "stock")
    rows.write.parquet(f"{root}/good")
    v["weekly_plan"].select(F.concat(F.lit("no package: "), F.col("shop").cast("string"))).coalesce(1).write.text(f"{root}/bad")
    read, failures = stores.scan(v.spark, root, rows.schema)
    return read.groupBy("machine").agg(F.count("machine").alias("n")).select("machine", F.lit("read").alias("state"), "n").union(failures.select(F.lit("?"), F.split("reason", ":")[0], F.lit(0).cast("long")))


def observation_commit(v: Views) -> DataFrame:
    """Two batches of observations, each followed by its failed attempts, then the first one again, another that ended before
    its entry, and one with a row that can't be: what readers find of snapshots, products and inventory."""
    store, seen = commits.Store(v.spark, _root(v, "observed")), shared.cut(v["observed"])
    rows = seen.where("NOT failed").withColumns({"sku_name": F.concat(F.lit("sku "), "sku"), "list_title": F.lit(" "), "image": F.lit(None).cast("string")})
    for batch in (0, 1):
        store.commit(f"batch {batch}", commits.observed(rows.where(F.col("batch") == batch)))
        store.commit(f"failures {batch}", commits.failed(seen.where("failed").where(F.col("batch") == batch)))
    assert store.commit("batch 0", lambda _: commits.observed(rows.where("batch = 0").withColumn("stock", F.lit(-1)))) is None
    for table, lost in commits.observed(rows.where("batch = 0").withColumn("stock", F.lit(-2))).items():
        lost.write.parquet(f"{store.root}/rows/{uuid.uuid4().hex}/{table}")
    try:
        store.commit("broken", commits.observed(rows.withColumn("stock", F.when(F.col("round_id") > 3, F.col("stock")))))
    except ValueError:
        pass
    long = lambda df, table, *keys: df.select(F.lit(table).alias("tbl"), F.concat_ws("|", *keys).alias("k"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in df.columns if c not in keys)).alias("val"))
    snaps = commits.snapshots(store).select("round_id", "shop", "offer", F.coalesce("sku", F.lit("-")).alias("sku"), "status", "stock", "seen_at")
    stock = commits.inventory(store).select("shop", "offer", "sku", "date", "stock", "seen_at")
    return long(snaps, "snapshots", "round_id", "shop", "offer", "sku").union(long(commits.products(store), "products", "offer")).union(long(stock, "inventory", "shop", "offer", "sku", "date"))


def judgment_commit(v: Views) -> DataFrame:
    """Judgments of neighbours and their evidence, committed machine by machine, the second one twice; each judgment with the
    evidence that was committed with it."""
    store = commits.Store(v.spark, _root(v, "judged"))
    pairs = v.sql("SELECT a.ordinal AS a, b.ordinal AS b, a.image % 2 = b.image % 2 AS same, a.ordinal % 3 AS machine, a.name || '/' || CAST(a.image AS STRING) AS va, b.name || '/' || CAST(b.image AS STRING) AS vb FROM {products} a JOIN {products} b ON b.ordinal = a.ordinal + 2")
    for machine in (0, 1, 2, 1):
        some = pairs.where(F.col("machine") == machine)
        evidence = some.select(F.col("a").alias("ordinal"), F.col("va").alias("version")).union(some.select("b", "vb")).distinct()
        store.commit(f"m{machine}", {"judgments": some.select("a", "b", "same", "va", "vb"), "evidence": evidence})
    judged, known = store.read("judgments"), store.read("evidence").select("_commit", "ordinal", "version")
    for end in ("a", "b"):
        judged = judged.join(known.select("_commit", F.col("ordinal").alias(end), F.col("version").alias(f"v{end}")), ["_commit", end, f"v{end}"], "left_semi")
    return judged.groupBy("_commit", "same").agg(F.count("a").alias("n"), F.sum("b").alias("total")).select(F.col("_commit").cast("long").alias("commit_no"), "same", "n", "total")


def judgment_scan(v: Views) -> DataFrame:
    """Confirmed relations of a stored set, its filter pushed into the scan; a table that the set lacks is empty."""
    root, rows = _root(v, "judged"), v["relations"]
    rows.write.parquet(f"{root}/relations")
    kept = v.spark.read.parquet(f"{root}/relations").where("confirmed")
    lacking = packages.table_or_empty(v.spark, f"{root}/exclusions", v["exclusions"].schema)
    return kept.groupBy("machine").agg(F.count("member").alias("members"), F.countDistinct("relation").alias("relations")).withColumn("exclusions", F.lit(lacking.count()))


def draft_versions(v: Views) -> DataFrame:
    root = _root(v, "draft")
    stores.commit_version(v["weekly_plan"].where("week = 1"), root)
    stores.commit_version(v["weekly_plan"].where("week = 2"), root)
    return stores.current(v.spark, root, v["weekly_plan"].schema)


def shop_list(v: Views) -> DataFrame:
    """Written as CSV and read again, its encoding found out."""
    root = _root(v, "shops")
    v["supplier"].select(F.col("s_suppkey").alias("shop"), F.concat(F.lit("店铺 "), "s_name").alias("name")).write.option("header", True).csv(root)
    return stores.read_list(v.spark, root).select(F.col("shop").cast("long").alias("shop"), "name")


def plan_documents(v: Views) -> DataFrame:
    """Weeks of the plan as documents, one with a machine that it doesn't name."""
    root = _root(v, "plans")
    plan = v["weekly_plan"].groupBy("week").agg(F.collect_list(F.struct("shop", "pages", "machine")).alias("shops"))
    machines = F.when(F.col("week") == 3, F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array(F.lit("m1"), F.lit("m2"), F.lit("m3")))
    plan.select(F.format_string("2024-W%02d", F.col("week")).alias("week"), machines.alias("machines"), "shops").write.json(root)
    return stores.read_plans(v.spark, root)


def csv_report(v: Views) -> DataFrame:
    """The click report, written as CSV and read again."""
    root = _root(v, "report")
    v.sql("SELECT shop, event, count(*) AS n FROM {click_log} GROUP BY shop, event").write.option("header", True).csv(root)
    return stores.read_list(v.spark, root).select("shop", "event", F.col("n").cast("long").alias("n"))


def manual_edits(v: Views) -> DataFrame:
    """Edits of members folded from their log: the last move or rejoin names the group, the last exclude or undo whether
    the member is out."""
    log = v["events"].select("event_id", F.col("user_id").alias("member"), F.element_at(F.create_map(*(F.lit(x) for p in (("view", "move"), ("click", "exclude"), ("signup", "undo"), ("purchase", "rejoin")) for x in p)), F.col("event_type")).alias("kind"))
    log = log.where("kind IS NOT NULL").withColumn("to", F.when(F.col("kind") == "move", F.col("event_id") % 50).when(F.col("kind") == "rejoin", F.col("member")))
    last = lambda value, *kinds: F.max_by(value, F.when(F.col("kind").isin(*kinds), F.col("event_id")))
    return log.groupBy("member").agg(last("to", "move", "rejoin").alias("grp"), F.coalesce(last("kind", "exclude", "undo") == "exclude", F.lit(False)).alias("excluded"), F.count("kind").alias("edits"))


def collected(v: Views) -> DataFrame:
    """Judgments collected from machines: of each key the first arrival stays; sets of an unknown version are refused."""
    sets = v["relations"].withColumn("known", F.pmod("member", F.lit(23)) != 0)
    first = sets.where("known").groupBy("member", "version").agg(F.min(F.struct("machine", "relation")).alias("first"), F.count("relation").alias("offered"))
    return first.select("member", "version", F.col("first.machine").alias("machine"), "offered")


def contexts(v: Views) -> DataFrame:
    """The canonical context that a recommendation is asked on, by digest."""
    fields = F.struct(F.lit("v1").alias("rule"), F.col("ordinal").alias("member"), F.col("name"), F.array_sort(F.array("shop", "source")).alias("tags"))
    return v["products"].select("ordinal", F.sha2(F.to_json(fields), 256).alias("context"))


def sku_points(v: Views) -> DataFrame:
    """SKUs over all segments: each day's point of the earliest segment that has one, and whether a later shape begins
    in view that day."""
    points = _series(v).groupBy("shop", "offer", "sku", "date").agg(F.min_by("stock", F.when(F.col("stock").isNotNull(), F.col("segment"))).alias("stock"))
    starts = series.switches(series.segments(series.freeze(v["inventory"], START, END), START, END)).select("shop", "offer", "date", F.lit(True).alias("begins"))
    return points.join(starts, ["shop", "offer", "date"], "left").select("shop", "offer", "sku", "date", "stock", (F.col("begins") & F.col("stock").isNotNull()).alias("b")).select("shop", "offer", "sku", "date", "stock", F.coalesce("b", F.lit(False)).alias("segment_start"))


def recall_coverage(v: Views, floor: int = 12) -> DataFrame:
    """Items, pairs among them, pairs recalled and those that reach the floor."""
    pairs = _whole(v).agg(F.count("a").alias("recalled"), F.count(F.when(F.col("score") >= floor, 1)).alias("above"))
    return v["products"].agg(F.count("ordinal").alias("eligible")).join(pairs).select("eligible", F.expr("eligible * (eligible - 1) DIV 2").alias("possible"), "recalled", "above")


def floored_edges(v: Views, floor: int = 12) -> DataFrame:
    """Pairs by what is done with them: a cached judgment counts at any score, below the floor none is asked for."""
    cached = F.pmod(F.col("a") * 7 + F.col("b"), F.lit(10)) < 3
    return _edges(v).select("a", "b", F.when(cached, "cached").when(F.col("score") < floor, "below").otherwise("todo").alias("state"))


def group_sizes(v: Views) -> DataFrame:
    """Clusters by size."""
    return _clusters(v)[1].groupBy("cluster").agg(F.count("ordinal").alias("size")).groupBy("size").agg(F.count("cluster").alias("n"))


def weight_replay(v: Views) -> DataFrame:
    """What becomes of the groups under other weights of negative judgments; recall, judgments and components are shared."""
    return matching.replays(v["products"], shared.cut(_whole(v)), [0.0, 1.0, 2.0, 5.0], shared.cut)


QUERIES = {
    "observation_commit": observation_commit, "judgment_commit": judgment_commit, "package_scan": package_scan, "judgment_scan": judgment_scan, "draft_versions": draft_versions, "shop_list": shop_list, "plan_documents": plan_documents, "csv_report": csv_report, "manual_edits": manual_edits,
    "collected_judgments": collected, "recommendation_contexts": contexts, "sku_points": sku_points, "recall_coverage": recall_coverage, "floored_edges": floored_edges, "group_sizes": group_sizes, "weight_replay": weight_replay,
}

SQL = {
    "observation_commit": duck("""WITH good AS (SELECT *, 2 * batch + 1 AS no, sku = 'default' AS one FROM {observed} WHERE NOT failed),
      last AS (SELECT round_id, shop, offer, max((no, seen_at, one)) AS l FROM good GROUP BY ALL),
      kept AS (SELECT g.* FROM good g JOIN last USING (round_id, shop, offer) WHERE g.one = l[3] QUALIFY row_number() OVER (PARTITION BY g.round_id, g.shop, g.offer, g.sku ORDER BY no DESC, seen_at DESC) = 1),
      tried AS (SELECT f.* FROM {observed} f LEFT JOIN last USING (round_id, shop, offer) WHERE f.failed AND (l IS NULL OR 2 * f.batch + 2 > l[1])),
      dated AS (SELECT *, CAST(CAST(seen_at AS TIMESTAMP) + INTERVAL 8 HOUR AS DATE) AS date FROM good),
      daily AS (SELECT shop, offer, sku, date, one, arg_max(stock, (no, seen_at, round_id)) AS stock, arg_max(seen_at, (no, seen_at)) AS seen_at FROM dated GROUP BY ALL),
      kinds AS (SELECT shop, offer, date, max((seen_at, one))[2] AS one FROM daily GROUP BY ALL),
      named AS (SELECT offer, no, round_id, seen_at, detail_title FROM good)
      SELECT 'snapshots' AS tbl, concat_ws('|', round_id, shop, offer, sku) AS k, concat_ws('|', 'success', stock, seen_at) AS val FROM kept
      UNION ALL SELECT 'snapshots', concat_ws('|', round_id, shop, offer, '-'), concat_ws('|', 'failed', '-', seen_at) FROM tried
      UNION ALL SELECT 'products', offer, concat_ws('|', coalesce(n, '-'), '-', f, l) FROM (SELECT offer, arg_max(detail_title, (no, seen_at, round_id)) FILTER (detail_title IS NOT NULL) AS n, min(m) AS f, max(seen_at) AS l FROM (SELECT *, max(seen_at) OVER (PARTITION BY offer, no) AS m FROM named) GROUP BY offer)
      UNION ALL SELECT 'inventory', concat_ws('|', d.shop, d.offer, d.sku, d.date), concat_ws('|', d.stock, d.seen_at) FROM daily d JOIN kinds q ON q.shop = d.shop AND q.offer = d.offer AND q.date = d.date AND q.one = d.one"""),
    "judgment_commit": duck("SELECT a.ordinal % 3 + 1 AS commit_no, a.image % 2 = b.image % 2 AS same, count(*) AS n, sum(b.ordinal)::BIGINT AS total FROM {products} a JOIN {products} b ON b.ordinal = a.ordinal + 2 GROUP BY ALL"),
    "package_scan": duck("SELECT machine, 'read' AS state, count(*) AS n FROM {machine_inventory} GROUP BY machine UNION ALL SELECT '?', 'not a package', 0"),
    "judgment_scan": duck("SELECT machine, count(*) AS members, count(DISTINCT relation) AS relations, 0 AS exclusions FROM {relations} WHERE confirmed GROUP BY machine"),
    "draft_versions": duck("SELECT * FROM {weekly_plan} WHERE week = 2"),
    "shop_list": "SELECT s_suppkey AS shop, '店铺 ' || s_name AS name FROM supplier",
    "plan_documents": duck("SELECT '2024-W0' || week AS week, shop, pages, machine, CASE WHEN week = 3 AND EXISTS (SELECT 1 FROM {weekly_plan} x WHERE x.week = 3 AND x.machine = 'm3') THEN 'unknown machine' END AS problem FROM {weekly_plan}"),
    "csv_report": duck("SELECT shop, event, len(list(id))::BIGINT AS n FROM {click_log} GROUP BY shop, event"),
    "manual_edits": """SELECT user_id AS member, (SELECT CASE event_type WHEN 'view' THEN event_id % 50 ELSE user_id END FROM events x WHERE x.user_id = e.user_id AND event_type IN ('view', 'purchase') ORDER BY event_id DESC LIMIT 1) AS grp,
      coalesce((SELECT event_type = 'click' FROM events x WHERE x.user_id = e.user_id AND event_type IN ('click', 'signup') ORDER BY event_id DESC LIMIT 1), false) AS excluded, count(*) AS edits FROM events e WHERE event_type <> 'error' GROUP BY user_id""",
    "collected_judgments": duck("SELECT DISTINCT ON (member, version) member, version, machine, count(*) OVER (PARTITION BY member, version) AS offered FROM {relations} WHERE member % 23 <> 0 ORDER BY member, version, machine, relation"),
    "recommendation_contexts": duck("""SELECT ordinal, sha256('{"rule":"v1","member":' || ordinal || ',"name":"' || name || '","tags":["' || least(shop, source) || '","' || greatest(shop, source) || '"]}') AS context FROM {products}"""),
    "sku_points": duck(_chain(False) + " , sw AS (SELECT shop, offer, low AS date FROM (SELECT *, row_number() OVER (PARTITION BY shop, offer ORDER BY segment) AS n FROM g WHERE low <= high) WHERE n > 1) SELECT shop, offer, sku, date, stock, stock IS NOT NULL AND (shop, offer, date) IN (SELECT (shop, offer, date) FROM sw) AS segment_start FROM series"),
    "recall_coverage": duck(f"WITH {_ALL_PAIRS} SELECT (SELECT count(*) FROM {{products}}) AS eligible, (SELECT count(*) * (count(*) - 1) // 2 FROM {{products}}) AS possible, count(*) AS recalled, count(*) FILTER (score >= 12) AS above FROM edges"),
    "floored_edges": duck(f"WITH {_PAIRS} SELECT a, b, CASE WHEN (a * 7 + b) % 10 < 3 THEN 'cached' WHEN score >= 12 THEN 'todo' ELSE 'below' END AS state FROM edges"),
}
