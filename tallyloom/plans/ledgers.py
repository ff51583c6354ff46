"""Grouping, ledger, package and search queries, as SQL that both engines run."""

from __future__ import annotations

from tallyloom.plans import relational
from tallyloom.plans.adapter import duck

#: Relations of several members: products of one source and picture are said to belong together.
_RELATIONS = "SELECT source || '/' || CAST(image AS STRING) AS relation, ordinal AS member FROM {products} WHERE ordinal % 3 <> 0"
_CODED = "SELECT * FROM {coded}"
_CLAIMED = "SELECT machine, shop, date, max(observed_at) AS claimed_at FROM {machine_inventory} GROUP BY machine, shop, date"

TEXTS = {
    "partition_refresh": f"""
      SELECT p.ordinal, coalesce(m.root, p.ordinal) AS grp FROM {{products}} p LEFT JOIN (
        SELECT member, root FROM (SELECT member, root, row_number() OVER (PARTITION BY member ORDER BY root) AS n FROM (SELECT member, min(member) OVER (PARTITION BY relation) AS root FROM ({_RELATIONS}) r) x) y WHERE n = 1) m ON m.member = p.ordinal""",
    "code_groups": f"""
      SELECT code, count(*) AS members, min(ordinal) AS representative, count(DISTINCT shop) AS shops, count(DISTINCT shop) < count(*) AS same_shop_twice FROM ({_CODED}) c WHERE code IS NOT NULL GROUP BY code""",
    "code_states": f"""SELECT CASE WHEN code IS NULL THEN 'uncoded' WHEN n = 1 THEN 'single' ELSE 'grouped' END AS state, count(*) AS n FROM (SELECT code, count(*) OVER (PARTITION BY code) AS n FROM ({_CODED}) c) x GROUP BY CASE WHEN code IS NULL THEN 'uncoded' WHEN n = 1 THEN 'single' ELSE 'grouped' END""",
    "group_facts": """
      SELECT image, count(DISTINCT shop) AS shops, count(*) AS products, min(name) AS first_name, min_by(name, ordinal) AS representative, count(DISTINCT source) > 1 AS conflict FROM {products} GROUP BY image""",
    "decision_conflicts": f"""
      SELECT a.member, min(a.relation) AS one, max(a.relation) AS other FROM (SELECT relation, member FROM ({_RELATIONS}) r UNION ALL SELECT 'p' || CAST(image AS STRING), ordinal FROM {{products}} WHERE ordinal % 7 = 0) a GROUP BY a.member HAVING count(DISTINCT a.relation) > 1""",
    "adopted_edges": """
      WITH now AS (SELECT DISTINCT name || '/' || CAST(image AS STRING) AS version FROM {products}),
      judged AS (SELECT 'm' || CAST(a.ordinal % 3 + 1 AS STRING) AS machine, CASE WHEN a.ordinal % 13 = 0 THEN 'old' ELSE a.name || '/' || CAST(a.image AS STRING) END AS va, CASE WHEN b.ordinal % 13 = 0 THEN 'old' ELSE b.name || '/' || CAST(b.image AS STRING) END AS vb,
        CASE WHEN a.ordinal % 9 = 0 THEN 'v1' ELSE 'v2' END AS contract FROM {products} a JOIN {products} b ON b.ordinal = a.ordinal + 2)
      SELECT machine, count(CASE WHEN contract = 'v2' AND x.version IS NOT NULL AND y.version IS NOT NULL THEN 1 END) AS adopted, count(CASE WHEN contract = 'v2' AND (x.version IS NULL OR y.version IS NULL) THEN 1 END) AS stale, count(CASE WHEN contract <> 'v2' THEN 1 END) AS other_contract
      FROM judged LEFT JOIN now x ON x.version = va LEFT JOIN now y ON y.version = vb GROUP BY machine""",
    "package_meta": """
      SELECT machine, max(CASE WHEN k = 'rows' THEN v END) AS n_rows, max(CASE WHEN k = 'shops' THEN v END) AS n_shops, max(CASE WHEN k = 'days' THEN v END) AS n_days FROM (
        SELECT machine, 'rows' AS k, count(*) AS v FROM {machine_inventory} GROUP BY machine UNION ALL SELECT machine, 'shops', count(DISTINCT shop) FROM {machine_inventory} GROUP BY machine
        UNION ALL SELECT machine, 'days', count(DISTINCT date) FROM {machine_inventory} GROUP BY machine) m GROUP BY machine""",
    "package_validation": """
      SELECT problem, count(*) AS n FROM (
        SELECT 'unknown offer' AS problem FROM {machine_inventory} i WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE CAST(c.c_custkey AS STRING) = i.offer)
        UNION ALL SELECT 'negative stock' FROM {machine_inventory} WHERE stock < 0
        UNION ALL SELECT 'repeated key' FROM (SELECT machine, shop, offer, sku, date FROM {machine_inventory} GROUP BY machine, shop, offer, sku, date HAVING count(*) > 1) r
        UNION ALL SELECT 'checked' FROM {machine_inventory}) x GROUP BY problem""",
    "week_slice": """SELECT machine, ISOYEAR(date) AS iso_year, weekofyear(date) AS iso_week, count(*) AS n, count(DISTINCT offer) AS offers FROM {machine_inventory} GROUP BY machine, ISOYEAR(date), weekofyear(date)""",
    "merged_versions": f"""
      SELECT offer, version, min_by(machine, claimed_at || machine) AS first_machine, max(claimed_at) AS last_at FROM (
        SELECT i.machine, i.offer, coalesce(CAST(i.stock % 5 AS STRING), '') || '/' || CASE WHEN i.stock % 2 = 0 THEN '' ELSE i.sku END AS version, c.claimed_at FROM {{machine_inventory}} i JOIN ({_CLAIMED}) c ON c.machine = i.machine AND c.shop = i.shop AND c.date = i.date) x GROUP BY offer, version""",
    "first_arrival": """SELECT machine, shop, min(observed_at) AS first_at, max(observed_at) AS last_at, count(DISTINCT date) AS days FROM {machine_inventory} GROUP BY machine, shop""",
    "convergence": """
      SELECT count(*) AS n_keys, count(CASE WHEN lo = hi THEN 1 END) AS agreed FROM (SELECT shop, offer, sku, date, min(stock) AS lo, max(stock) AS hi FROM {machine_inventory} GROUP BY shop, offer, sku, date HAVING count(*) > 1) x""",
    "newest_weeks": """SELECT week, machine, pages FROM (SELECT week, machine, sum(pages) AS p, CAST(sum(pages) AS BIGINT) AS pages, rank() OVER (ORDER BY week DESC) AS r FROM {weekly_plan} GROUP BY week, machine) x WHERE r <= 6""",
    "plan_changes": """
      SELECT a.week, count(CASE WHEN b.machine IS NULL OR a.machine <> b.machine THEN 1 END) AS moved, count(*) AS shops FROM {weekly_plan} a LEFT JOIN {weekly_plan} b ON b.shop = a.shop AND b.week = a.week - 1 GROUP BY a.week""",
    "kept_success": """
      SELECT round_id, shop, offer, sku, price AS kept_price, seen_at AS kept_at, dropped FROM (
        SELECT *, row_number() OVER (PARTITION BY round_id, shop, offer, sku ORDER BY l_orderkey DESC, attempt DESC, price DESC, seen_at DESC) AS nth, count(*) OVER (PARTITION BY round_id, shop, offer, sku) - 1 AS dropped FROM {snapshots} WHERE status = 'success') x WHERE nth = 1 AND dropped > 0""",
    "rekeyed_skus": """SELECT offer, sku, max(status) AS status, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM {snapshots} GROUP BY offer, sku""",
    "renamed_offers": """SELECT p.p_partkey AS offer, coalesce(nullif(m.title, ''), p.p_name) AS name FROM {part} p LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'new ' || p_brand END AS title FROM {part} WHERE p_partkey % 2 = 0) m ON m.p_partkey = p.p_partkey""",
    "field_search": """SELECT p_partkey AS offer FROM {part} WHERE lower(p_name || ' ' || p_brand || ' ' || p_type) LIKE '%brand#1%' OR p_size = 7""",
    "pause_accounting": """
      SELECT shop, CAST(sum(CASE WHEN ms IS NULL THEN 0 ELSE least(ms, 600000) END) AS BIGINT) AS paused_ms, count(CASE WHEN ms IS NULL THEN 1 END) AS ongoing FROM (
        SELECT shop, event, lead(EPOCHMS(ts)) OVER (PARTITION BY shop ORDER BY EPOCHMS(ts), id) - EPOCHMS(ts) AS ms FROM {event_log}) x WHERE event = 'verification_appear' GROUP BY shop""",
    "transfer_split": """
      SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NOT NULL THEN 'skip' WHEN p.ordinal % 11 = 0 THEN 'missing' ELSE 'upload' END AS state FROM {products} p LEFT JOIN {labels} b ON b.doc_id = p.ordinal) x GROUP BY state""",
    "todo_by_machine": """
      SELECT w.machine, count(*) AS shops, count(CASE WHEN g.shop IS NULL THEN 1 END) AS without_rounds FROM {weekly_plan} w LEFT JOIN (SELECT DISTINCT shop FROM {shop_rounds}) g ON g.shop = w.shop GROUP BY w.machine""",
}

QUERIES = {name: (lambda v, text=text: v.sql(text)) for name, text in TEXTS.items()}
SQL = {name: duck(text) for name, text in TEXTS.items()}

QUERIES["pause_accounting"] = relational.pause_accounting
