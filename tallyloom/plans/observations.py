"""Writes as latest-wins reads, audits of packages and rounds, and small projections: a Spark text and, beside it, a
DuckDB text of its own that reaches the result another way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import ordering
from tallyloom.plans.adapter import Views, duck

_NOW = "TIMESTAMP '2024-01-20 15:57:00'"
_CLAIMS = "SELECT shop, date, machine, max(observed_at) AS claim_at FROM {machine_inventory} GROUP BY shop, date, machine"

#: name -> (Spark, DuckDB)
TEXTS: dict[str, tuple[str, str]] = {
    # ---- writes, as what a reader finds afterwards
    "shop_upsert": (
        "SELECT shop, min(week) AS first_week, max(week) AS last_week, max_by(pages, week) AS pages, max_by(machine, week) AS machine FROM {weekly_plan} GROUP BY shop",
        "SELECT shop, (SELECT min(week) FROM {weekly_plan} w WHERE w.shop = p.shop) AS first_week, week AS last_week, pages, machine FROM {weekly_plan} p WHERE NOT EXISTS (SELECT 1 FROM {weekly_plan} w WHERE w.shop = p.shop AND w.week > p.week)",
    ),
    "asset_insert": (
        "SELECT image, min_by(name, ordinal) AS name, min(ordinal) AS ordinal, count(*) AS offered FROM {products} GROUP BY image",
        "SELECT image, name, ordinal, offered FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY ordinal) AS n, count(*) OVER (PARTITION BY image) AS offered FROM {products}) WHERE n = 1",
    ),
    # an offer listed again keeps its row; what is known of it is what was seen last
    "listing_upsert": (
        "SELECT round_id, shop, offer, count(*) AS times, max_by(price, struct(l_orderkey, attempt, price)) AS price FROM {snapshots} GROUP BY round_id, shop, offer",
        "SELECT round_id, shop, offer, times, price FROM (SELECT *, count(*) OVER (PARTITION BY round_id, shop, offer) AS times, row_number() OVER (PARTITION BY round_id, shop, offer ORDER BY l_orderkey DESC, attempt DESC, price DESC) AS n FROM {snapshots}) WHERE n = 1",
    ),
    # a shop's listing is replaced as a whole by its last batch; a batch without a success is not believed
    "listing_replace": (
        "SELECT round_id, shop, offer, attempt AS batch, row_number() OVER (PARTITION BY round_id, shop ORDER BY price DESC, offer) AS place FROM (SELECT *, max(CASE WHEN won = 1 THEN attempt END) OVER (PARTITION BY round_id, shop) AS last FROM (SELECT round_id, shop, offer, attempt, max(price) AS price, max(max(CASE WHEN status = 'success' THEN 1 ELSE 0 END)) OVER (PARTITION BY round_id, shop, attempt) AS won FROM {snapshots} GROUP BY round_id, shop, offer, attempt) x) y WHERE attempt = last",
        "WITH b AS (SELECT round_id, shop, max(attempt) AS batch FROM {snapshots} WHERE status = 'success' GROUP BY ALL) SELECT round_id, shop, offer, batch, row_number() OVER (PARTITION BY round_id, shop ORDER BY max(price) DESC, offer) AS place FROM {snapshots} JOIN b USING (round_id, shop) WHERE attempt = batch GROUP BY round_id, shop, offer, batch",
    ),
    # a failure is recorded unless the offer was handled; its price falls back to the listing's
    "failure_records": (
        "SELECT f.round_id, f.shop, f.offer, count(*) AS failures, coalesce(max(CASE WHEN f.sku % 2 = 0 THEN f.price END), max(l.price)) AS price FROM {snapshots} f LEFT ANTI JOIN (SELECT DISTINCT round_id, shop, offer FROM {snapshots} WHERE status IN ('success', 'skipped')) h ON h.round_id = f.round_id AND h.shop = f.shop AND h.offer = f.offer LEFT JOIN (SELECT round_id, shop, offer, min(price) AS price FROM {snapshots} WHERE attempt <= 6 GROUP BY round_id, shop, offer) l ON l.round_id = f.round_id AND l.shop = f.shop AND l.offer = f.offer GROUP BY f.round_id, f.shop, f.offer",
        "WITH g AS (SELECT round_id, shop, offer, count(*) AS failures, bool_or(status IN ('success', 'skipped')) AS handled, max(CASE WHEN sku % 2 = 0 THEN price END) AS own, min(CASE WHEN attempt <= 6 THEN price END) AS listed FROM {snapshots} GROUP BY ALL) SELECT round_id, shop, offer, failures, coalesce(own, listed) AS price FROM g WHERE NOT handled",
    ),
    "plan_replacement": (
        "SELECT week, count(*) AS shops, count(CASE WHEN same THEN 1 END) AS same, CASE WHEN count(*) = count(CASE WHEN same THEN 1 END) THEN 'kept' ELSE 'replaced' END AS outcome FROM (SELECT coalesce(a.week, b.week + 1) AS week, a.machine <=> b.machine AND a.pages <=> b.pages AS same FROM {weekly_plan} a FULL OUTER JOIN {weekly_plan} b ON b.shop = a.shop AND b.week = a.week - 1) x WHERE week BETWEEN 2 AND 4 GROUP BY week",
        "SELECT week, count(*) AS shops, count(*) FILTER (EXISTS (SELECT 1 FROM {weekly_plan} b WHERE b.shop = a.shop AND b.week = a.week - 1 AND b.machine = a.machine AND b.pages = a.pages)) AS same, CASE WHEN count(*) FILTER (NOT EXISTS (SELECT 1 FROM {weekly_plan} b WHERE b.shop = a.shop AND b.week = a.week - 1 AND b.machine = a.machine AND b.pages = a.pages)) = 0 THEN 'kept' ELSE 'replaced' END AS outcome FROM {weekly_plan} a WHERE week > 1 GROUP BY week",
    ),
    "config_once": (
        "SELECT md5(props) AS params_hash, min_by(props, event_id) AS params, min(event_id) AS first_id, count(*) AS uses FROM {events} GROUP BY md5(props)",
        "SELECT DISTINCT ON (props) md5(props) AS params_hash, props AS params, event_id AS first_id, (SELECT count(*) FROM {events} x WHERE x.props = e.props) AS uses FROM {events} e ORDER BY props, event_id",
    ),
    # ---- predicates
    "owned_identities": (
        "SELECT i.machine, i.offer, i.sku, i.seen FROM (SELECT machine, offer, sku, max(observed_at) AS seen FROM {machine_inventory} GROUP BY machine, offer, sku) i LEFT ANTI JOIN (SELECT machine, offer, sku, max(observed_at) AS seen FROM {machine_inventory} GROUP BY machine, offer, sku) o ON o.offer = i.offer AND o.sku = i.sku AND o.seen = i.seen AND o.machine <> i.machine",
        "WITH s AS (SELECT machine, offer, sku, max(observed_at) AS seen FROM {machine_inventory} GROUP BY ALL) SELECT machine, offer, sku, seen FROM (SELECT *, count(*) OVER (PARTITION BY offer, sku, seen) AS n FROM s) WHERE n = 1",
    ),
    "pending_relations": (
        "SELECT r.relation, NOT max(confirmed) AS unconfirmed, max(m.n) > 1 AS contested FROM {relations} r JOIN (SELECT member, count(DISTINCT relation) AS n FROM {relations} GROUP BY member) m ON m.member = r.member GROUP BY r.relation HAVING NOT max(confirmed) OR max(m.n) > 1",
        "SELECT relation, unconfirmed, contested FROM (SELECT relation, NOT bool_or(confirmed) AS unconfirmed, bool_or(EXISTS (SELECT 1 FROM {relations} o WHERE o.member = r.member AND o.relation <> r.relation)) AS contested FROM {relations} r GROUP BY relation) WHERE unconfirmed OR contested",
    ),
    # rounds without an ending, newest first; what may go on at this moment and what must stop
    "active_rounds": (
        f"SELECT x.*, m.moment, run_date = CAST(m.at + INTERVAL '8' HOUR AS DATE) AS resumable, NOT (run_date = CAST(m.at + INTERVAL '8' HOUR AS DATE) AND date_format(m.at + INTERVAL '8' HOUR, 'HH:mm') < '23:55') AS must_stop, row_number() OVER (PARTITION BY m.moment, run_date ORDER BY round_id DESC) AS nth FROM (SELECT round_id, CAST(min(ts) + INTERVAL '8' HOUR AS DATE) AS run_date FROM {{event_log}} GROUP BY round_id HAVING max(CASE WHEN event = 'deny_hit' AND id % 401 = 0 THEN 1 ELSE 0 END) = 0) x JOIN (SELECT 'late' AS moment, {_NOW} AS at UNION ALL SELECT 'early', {_NOW} - INTERVAL '3' MINUTE) m ON true",
        f"WITH r AS (SELECT round_id, CAST(min(ts) + INTERVAL 8 HOUR AS DATE) AS run_date FROM {{event_log}} e WHERE NOT EXISTS (SELECT 1 FROM {{event_log}} x WHERE x.round_id = e.round_id AND x.event = 'deny_hit' AND x.id % 401 = 0) GROUP BY round_id) SELECT r.*, moment, run_date = DATE '2024-01-20' AS resumable, moment = 'late' OR run_date <> DATE '2024-01-20' AS must_stop, (SELECT count(*) FROM r o WHERE o.run_date = r.run_date AND o.round_id >= r.round_id) AS nth FROM r, (SELECT unnest(['late', 'early']) AS moment) m",
    ),
    "trusted_sources": (
        "SELECT s_nationkey AS machine, s_name AS source FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM {supplier} WHERE s_acctbal > 0 AND s_name RLIKE '^[A-Za-z]+#[0-9]+$') x WHERE n = 1",
        "SELECT s_nationkey AS machine, arg_min(s_name, s_suppkey) AS source FROM {supplier} WHERE s_acctbal > 0 AND regexp_full_match(s_name, '[A-Za-z]+#[0-9]+') GROUP BY 1",
    ),
    # lines that only tell of a plan's deviations are no reason to end
    "ending_notes": (
        "SELECT conv_id, turn, nullif(trim(array_join(filter(split(text, '\\n'), x -> NOT startswith(x, 'The') AND NOT startswith(x, 'In')), '\\n')), '') AS note FROM {conversations}",
        "SELECT conv_id, turn, nullif(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x[1:3] <> 'The' AND x[1:2] <> 'In'), chr(10))), '') AS note FROM {conversations}",
    ),
    # ---- joins
    "offers_with_products": (
        "SELECT DISTINCT i.shop, i.offer, p.p_name AS name FROM {inventory} i LEFT JOIN {part} p ON CAST(p.p_partkey AS STRING) = i.offer",
        "SELECT shop, offer, (SELECT p_name FROM {part} WHERE p_partkey = CAST(offer AS BIGINT)) AS name FROM {inventory} GROUP BY shop, offer",
    ),
    "picture_assets": (
        "SELECT p.ordinal, p.image, e.label AS kind, e.vec_id IS NULL AS missing FROM {products} p LEFT JOIN {embeddings} e ON e.vec_id = p.image",
        "SELECT ordinal, image, (SELECT label FROM {embeddings} WHERE vec_id = image) AS kind, image NOT IN (SELECT vec_id FROM {embeddings}) AS missing FROM {products}",
    ),
    # a SKU's own picture of the same observation, else the product's, else none
    "picture_fallback": (
        "SELECT i.offer, i.sku, i.date, CASE WHEN o.image IS NOT NULL THEN 'sku' WHEN m.image IS NOT NULL THEN 'product' ELSE 'missing' END AS source, coalesce(o.image, m.image) AS image FROM {inventory} i LEFT JOIN (SELECT offer, sku, observed, max_by(stock, observed) AS image FROM {inventory} WHERE observed % 3 = 0 GROUP BY offer, sku, observed) o ON o.offer = i.offer AND o.sku = i.sku AND o.observed = i.observed LEFT JOIN (SELECT offer, date, max_by(stock, observed) AS image FROM {inventory} WHERE observed % 4 = 0 GROUP BY offer, date) m ON m.offer = i.offer AND m.date = i.date",
        "SELECT offer, sku, date, CASE WHEN own IS NOT NULL THEN 'sku' WHEN main IS NOT NULL THEN 'product' ELSE 'missing' END AS source, coalesce(own, main) AS image FROM (SELECT *, CASE WHEN observed % 3 = 0 THEN stock END AS own, (SELECT x.stock FROM {inventory} x WHERE x.offer = i.offer AND x.date = i.date AND x.observed % 4 = 0 ORDER BY x.observed DESC LIMIT 1) AS main FROM {inventory} i)",
    ),
    # ---- audits
    "missing_pictures": (
        "SELECT shop, count(*) AS n, min(image) AS first_image FROM {products} p LEFT ANTI JOIN {embeddings} e ON e.vec_id = p.image GROUP BY shop",
        "SELECT shop, count(*) AS n, min(image) AS first_image FROM {products} WHERE NOT EXISTS (SELECT 1 FROM {embeddings} WHERE vec_id = image) GROUP BY shop",
    ),
    "share_coverage": (
        "SELECT m.machine, count(*) AS shop_days, count(c.n) AS covered, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n_rows FROM (SELECT machine, shop, date FROM (SELECT DISTINCT machine, shop FROM {machine_inventory}) a CROSS JOIN (SELECT DISTINCT date FROM {machine_inventory}) b) m LEFT JOIN (SELECT machine, shop, date, count(*) AS n FROM {machine_inventory} GROUP BY machine, shop, date) c ON c.machine = m.machine AND c.shop = m.shop AND c.date = m.date GROUP BY m.machine",
        "SELECT machine, count(DISTINCT shop) * (SELECT count(DISTINCT date) FROM {machine_inventory}) AS shop_days, count(DISTINCT shop || '|' || CAST(date AS VARCHAR)) AS covered, count(*) AS n_rows FROM {machine_inventory} GROUP BY machine",
    ),
    "cold_start": (
        "SELECT 'inventory' AS what, count(*) > 0 AS fine, CAST(min(date) AS STRING) AS low, CAST(max(date) AS STRING) AS high FROM {machine_inventory} UNION ALL SELECT 'pictures', count(CASE WHEN e.vec_id IS NULL THEN 1 END) = 0, CAST(min(p.image) AS STRING), CAST(max(p.image) AS STRING) FROM {products} p LEFT JOIN {embeddings} e ON e.vec_id = p.image UNION ALL SELECT 'machines', count(CASE WHEN m.machine IS NULL THEN 1 END) = 0, min(w.machine), max(w.machine) FROM (SELECT DISTINCT machine FROM {weekly_plan}) w LEFT JOIN (SELECT DISTINCT machine FROM {machine_inventory}) m ON m.machine = w.machine",
        "SELECT 'inventory' AS what, EXISTS (FROM {machine_inventory}) AS fine, (SELECT CAST(min(date) AS VARCHAR) FROM {machine_inventory}) AS low, (SELECT CAST(max(date) AS VARCHAR) FROM {machine_inventory}) AS high UNION ALL SELECT 'pictures', NOT EXISTS (SELECT image FROM {products} EXCEPT SELECT vec_id FROM {embeddings}), (SELECT CAST(min(image) AS VARCHAR) FROM {products}), (SELECT CAST(max(image) AS VARCHAR) FROM {products}) UNION ALL SELECT 'machines', NOT EXISTS (SELECT machine FROM {weekly_plan} EXCEPT SELECT machine FROM {machine_inventory}), (SELECT min(machine) FROM {weekly_plan}), (SELECT max(machine) FROM {weekly_plan})",
    ),
    # ---- orders and sets
    "member_order": (
        "SELECT shop, offer, sold, row_number() OVER (PARTITION BY shop ORDER BY sold DESC, offer) AS place FROM (SELECT shop, offer, CAST(sum(coalesce(fell, 0)) AS BIGINT) AS sold FROM (SELECT shop, offer, greatest(lag(stock) OVER (PARTITION BY shop, offer, sku ORDER BY date) - stock, 0) AS fell FROM {inventory} WHERE stock IS NOT NULL) x GROUP BY shop, offer) y",
        "WITH s AS (SELECT shop, offer, sku, stock, row_number() OVER (PARTITION BY shop, offer, sku ORDER BY date) AS n FROM {inventory} WHERE stock IS NOT NULL), f AS (SELECT b.shop, b.offer, CAST(sum(greatest(coalesce(a.stock - b.stock, 0), 0)) AS BIGINT) AS sold FROM s b LEFT JOIN s a ON a.shop = b.shop AND a.offer = b.offer AND a.sku = b.sku AND a.n = b.n - 1 GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY shop ORDER BY sold DESC, offer) AS place FROM f",
    ),
    "unsold_offers": (
        "SELECT shop, offer FROM (SELECT shop, offer, max(stock) AS high, min(stock) AS low FROM {inventory} WHERE stock IS NOT NULL AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-11' GROUP BY shop, offer) x WHERE high = low",
        "SELECT shop, offer FROM {inventory} WHERE stock IS NOT NULL AND date IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY ALL HAVING count(DISTINCT stock) = 1",
    ),
    "all_shops": (
        "SELECT shop, 'planned' AS origin FROM (SELECT DISTINCT 'S' || CAST(shop % 9 AS STRING) AS shop FROM {weekly_plan}) p UNION ALL SELECT shop, 'seen only' FROM (SELECT DISTINCT shop FROM {inventory}) i LEFT ANTI JOIN (SELECT DISTINCT 'S' || CAST(shop % 9 AS STRING) AS shop FROM {weekly_plan}) p ON p.shop = i.shop",
        "SELECT shop, CASE WHEN bool_or(planned) THEN 'planned' ELSE 'seen only' END AS origin FROM (SELECT 'S' || (shop % 9) AS shop, true AS planned FROM {weekly_plan} UNION ALL SELECT shop, false FROM {inventory}) GROUP BY shop",
    ),
    "asset_references": (
        "SELECT image FROM {products} UNION SELECT vec_id FROM {embeddings} UNION SELECT stock FROM {inventory} WHERE stock IS NOT NULL",
        "SELECT DISTINCT image FROM (SELECT image FROM {products} UNION ALL SELECT vec_id FROM {embeddings} UNION ALL SELECT stock FROM {inventory} WHERE stock IS NOT NULL)",
    ),
    # ---- scalars
    "name_sources": (
        "SELECT offer, sku, date, CASE WHEN sku = 'default' AND offer LIKE '%5' THEN 'system_default' ELSE 'observed' END AS name_source, CASE WHEN observed % 4 = 0 THEN 'platform' ELSE 'derived' END AS id_source, concat_ws(' / ', shop, offer, nullif(sku, 'default')) AS display FROM {inventory}",
        "SELECT offer, sku, date, CASE WHEN sku = 'default' AND right(offer, 1) = '5' THEN 'system_default' ELSE 'observed' END AS name_source, ['platform', 'derived', 'derived', 'derived'][1 + observed % 4] AS id_source, shop || ' / ' || offer || CASE sku WHEN 'default' THEN '' ELSE ' / ' || sku END AS display FROM {inventory}",
    ),
    "terminal_reasons": (
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN CASE WHEN o_orderpriority LIKE '1%' THEN 'DAY_BOUNDARY' ELSE 'ABORTED' END ELSE 'UNKNOWN' END AS reason FROM {orders}",
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderstatus = 'P' AND o_orderpriority[1] = '1' THEN 'DAY_BOUNDARY' ELSE coalesce(map {{'F': 'COMPLETED', 'P': 'ABORTED'}}[o_orderstatus], 'UNKNOWN') END AS reason FROM {orders}".replace("{{", "{").replace("}}", "}"),
    ),
    "note_fields": (
        "SELECT id, m['page'] AS page, m['idx'] AS idx, size(m) AS n FROM (SELECT id, str_to_map(note, '&', '=') AS m FROM {event_log}) x",
        "SELECT id, regexp_extract(note, 'page=([^&]*)', 1) AS page, regexp_extract(note, 'idx=([^&]*)', 1) AS idx, CAST(len(string_split(note, '&')) AS INT) AS n FROM {event_log}",
    ),
    # ---- packages
    # a package's machine must be that of its folder, and its week readable
    "package_discovery": (
        "SELECT path, CAST(regexp_extract(path, '/data/([0-9]{4})/', 1) AS BIGINT) AS iso_year, CAST(regexp_extract(path, '/W([0-9]{2})-', 1) AS BIGINT) AS iso_week, regexp_extract(path, '/W[0-9]{2}-(m[0-9]+)', 1) AS machine FROM {package_paths} WHERE path RLIKE '^raw-(m[0-9]+)/data/[0-9]{4}/W[0-9]{2}-\\\\1[.]db[.]gz$'",
        "SELECT path, CAST(p[3] AS BIGINT) AS iso_year, CAST(substr(p[4], 2, 2) AS BIGINT) AS iso_week, substr(p[1], 5) AS machine FROM (SELECT path, string_split(path, '/') AS p FROM {package_paths}) WHERE p[4] = 'W' || substr(p[4], 2, 2) || '-' || substr(p[1], 5) || '.db.gz'",
    ),
    "object_keys": (
        "SELECT regexp_extract(line, '(img/[0-9a-f]{2}/[0-9a-f]+[.][a-z]+)', 1) AS key, CASE WHEN line LIKE 'key:%' THEN 'labelled' ELSE 'table' END AS format FROM {object_lines} WHERE line RLIKE 'img/[0-9a-f]{2}/[0-9a-f]+[.][a-z]+'",
        "SELECT trim(CASE WHEN line[1:4] = 'key:' THEN substr(line, 5) ELSE string_split(line, ' | ')[1] END) AS key, CASE WHEN line[1:4] = 'key:' THEN 'labelled' ELSE 'table' END AS format FROM {object_lines} WHERE contains(line, 'img/')",
    ),
    "owned_slice": (
        f"SELECT i.machine, ISOYEAR(i.date) AS iso_year, weekofyear(i.date) AS iso_week, count(*) AS n, count(DISTINCT offer) AS offers FROM {{machine_inventory}} i LEFT ANTI JOIN (SELECT c.shop, c.date, c.machine FROM ({_CLAIMS}) c JOIN (SELECT shop, date, max(observed_at) AS latest FROM {{machine_inventory}} GROUP BY shop, date) v ON v.shop = c.shop AND v.date = c.date AND v.latest = c.claim_at) o ON o.shop = i.shop AND o.date = i.date AND o.machine <> i.machine GROUP BY i.machine, ISOYEAR(i.date), weekofyear(i.date)",
        "WITH t AS (SELECT *, max(observed_at) OVER (PARTITION BY shop, date) AS latest, max(observed_at) OVER (PARTITION BY shop, date, machine) AS own FROM {machine_inventory}), w AS (SELECT shop, date, list(DISTINCT machine) AS winners FROM t WHERE own = latest GROUP BY ALL) SELECT t.machine, isoyear(t.date) AS iso_year, weekofyear(t.date) AS iso_week, count(*) AS n, count(DISTINCT offer) AS offers FROM t JOIN w USING (shop, date) WHERE winners = [t.machine] GROUP BY ALL",
    ),
    # a package whose content is in the ledger already is not taken in again
    "package_ledger": (
        "SELECT machine, iso_week, n, NOT seen AS taken FROM (SELECT *, row_number() OVER (PARTITION BY p1, p2, n ORDER BY machine, iso_week) > 1 AS seen FROM (SELECT machine, weekofyear(date) AS iso_week, count(*) AS n, sum(HEX7(substring(h, 1, 7))) AS p1, sum(HEX7(substring(h, 8, 7))) AS p2 FROM (SELECT machine, date, md5(shop || '|' || offer || '|' || sku || '|' || CAST(date AS STRING)) AS h FROM {machine_inventory} UNION ALL SELECT 'm0', date, md5(shop || '|' || offer || '|' || sku || '|' || CAST(date AS STRING)) FROM {machine_inventory} WHERE machine = 'm2') x GROUP BY machine, weekofyear(date)) y) z",
        "WITH k AS (SELECT machine, weekofyear(date) AS iso_week, list_sort(list(shop || '|' || offer || '|' || sku || '|' || CAST(date AS VARCHAR))) AS rows_ FROM {machine_inventory} GROUP BY ALL), a AS (FROM k UNION ALL SELECT 'm0', iso_week, rows_ FROM k WHERE machine = 'm2') SELECT machine, iso_week, CAST(len(rows_) AS BIGINT) AS n, NOT EXISTS (SELECT 1 FROM a b WHERE b.rows_ = a.rows_ AND b.machine < a.machine) AS taken FROM a",
    ),
    # rows of several machines keep their source's ids beside the machine's name; one id with two contents is an error
    "natural_keys": (
        "SELECT machine, source_id, count(*) AS n, count(DISTINCT content) AS contents, count(DISTINCT content) > 1 AS broken FROM (SELECT machine, observed % 500 AS source_id, shop || '/' || sku AS content FROM {machine_inventory}) x GROUP BY machine, source_id",
        "SELECT machine, observed % 500 AS source_id, count(*) AS n, len(list_distinct(list(shop || '/' || sku)))::BIGINT AS contents, min(shop || '/' || sku) <> max(shop || '/' || sku) AS broken FROM {machine_inventory} GROUP BY 1, 2",
    ),
    # a judgment must hash to the key that it is kept under
    "consistency_gate": (
        "SELECT ordinal, sha2(name || '|' || CAST(image AS STRING), 256) = stored AS consistent FROM (SELECT ordinal, name, image, sha2(CASE WHEN ordinal % 19 = 0 THEN 'x' ELSE name || '|' || CAST(image AS STRING) END, 256) AS stored FROM {products}) x",
        "SELECT ordinal, ordinal % 19 <> 0 AS consistent FROM {products}",
    ),
    # packages still to take: not one's own, not an older week that is in the ledger with all its pictures
    "package_selection": (
        "SELECT p.machine, p.iso_week, CASE WHEN l.machine IS NULL THEN 'new' ELSE 'pictures missing' END AS why FROM (SELECT DISTINCT machine, weekofyear(date) AS iso_week FROM {machine_inventory}) p LEFT JOIN (SELECT machine, weekofyear(date) AS iso_week, count(CASE WHEN observed % 50 = 0 THEN 1 END) AS gaps FROM {machine_inventory} WHERE weekofyear(date) < 4 GROUP BY machine, weekofyear(date)) l ON l.machine = p.machine AND l.iso_week = p.iso_week WHERE p.machine <> 'm1' AND (l.machine IS NULL OR l.gaps > 0)",
        "SELECT machine, iso_week, CASE WHEN iso_week < 4 THEN 'pictures missing' ELSE 'new' END AS why FROM (SELECT machine, weekofyear(date) AS iso_week, bool_or(observed % 50 = 0) AS gap FROM {machine_inventory} WHERE machine IN ('m2', 'm3') GROUP BY 1, 2) WHERE iso_week >= 4 OR gap",
    ),
    # conflicts of a week; a time that can't be read keeps its row
    "week_conflicts": (
        "SELECT id, seen_at FROM (SELECT id, CASE WHEN id % 29 = 0 THEN 'unreadable' ELSE CAST(ts AS STRING) END AS seen_at FROM {event_log} WHERE event = 'deny_hit') x WHERE coalesce(try_cast(seen_at AS TIMESTAMP) >= TIMESTAMP '2024-01-08' AND try_cast(seen_at AS TIMESTAMP) < TIMESTAMP '2024-01-15', true)",
        "SELECT id, CASE WHEN id % 29 = 0 THEN 'unreadable' ELSE CAST(ts AS VARCHAR) END AS seen_at FROM {event_log} WHERE event = 'deny_hit' AND (id % 29 = 0 OR isoyear(ts) = 2024 AND weekofyear(ts) = 2)",
    ),
    # three copies of a text: whose change counts; line ends and trailing blanks are no change
    "text_sync": (
        "SELECT conv_id, turn, CASE WHEN mine = theirs THEN 'equal' WHEN mine = base THEN 'take theirs' WHEN theirs = base THEN 'send mine' ELSE 'conflict' END AS verdict FROM (SELECT conv_id, turn, sha2(regexp_replace(regexp_replace(text, '[ \\t]+(\\r?\\n|$)', '\\n'), '[ \\n]+$', ''), 256) AS base, sha2(regexp_replace(regexp_replace(CASE WHEN conv_id % 3 = 0 THEN text || ' mine' ELSE text || '  ' END, '[ \\t]+(\\r?\\n|$)', '\\n'), '[ \\n]+$', ''), 256) AS mine, sha2(regexp_replace(regexp_replace(CASE WHEN turn % 2 = 0 THEN text || ' theirs' ELSE text END, '[ \\t]+(\\r?\\n|$)', '\\n'), '[ \\n]+$', ''), 256) AS theirs FROM {conversations} WHERE text IS NOT NULL) x",
        "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN 'conflict' WHEN conv_id % 3 = 0 THEN 'send mine' WHEN turn % 2 = 0 THEN 'take theirs' ELSE 'equal' END AS verdict FROM {conversations} WHERE text IS NOT NULL",
    ),
    # a manifest that lost or moved entries holds the previous one until someone confirms
    "manifest_refresh": (
        "SELECT week, added, removed, moved, CASE WHEN removed + moved > 0 THEN 'held' WHEN added > 0 THEN 'refreshed' ELSE 'equal' END AS outcome FROM (SELECT week, count(CASE WHEN b.shop IS NULL THEN 1 END) AS added, count(CASE WHEN a.shop IS NULL THEN 1 END) AS removed, count(CASE WHEN a.machine <> b.machine THEN 1 END) AS moved FROM (SELECT w AS week, shop FROM (SELECT DISTINCT shop FROM {weekly_plan}) s CROSS JOIN (SELECT DISTINCT week AS w FROM {weekly_plan} WHERE week > 1) k) g LEFT JOIN {listed_sources} a USING (week, shop) LEFT JOIN (SELECT week + 1 AS week, shop, machine FROM {listed_sources}) b USING (week, shop) WHERE a.shop IS NOT NULL OR b.shop IS NOT NULL GROUP BY week) x",
        "WITH d AS (SELECT coalesce(a.week, b.week + 1) AS week, a.machine AS now, b.machine AS was FROM {listed_sources} a FULL JOIN {listed_sources} b ON b.shop = a.shop AND b.week = a.week - 1), c AS (SELECT week, count(*) FILTER (was IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, count(*) FILTER (now <> was) AS moved FROM d WHERE week BETWEEN 2 AND 4 GROUP BY week) SELECT *, CASE WHEN removed + moved > 0 THEN 'held' WHEN added > 0 THEN 'refreshed' ELSE 'equal' END AS outcome FROM c",
    ),
    # what a frozen input must be: known members, each once, evidence not later than the range's end
    "frozen_manifest": (
        "SELECT problem, count(*) AS n FROM (SELECT 'late evidence' AS problem FROM {inventory} WHERE date > DATE '2024-01-25' UNION ALL SELECT 'unknown member' FROM {relations} r LEFT ANTI JOIN {products} p ON p.ordinal = r.member UNION ALL SELECT 'repeated member' FROM (SELECT relation, member FROM {relations} GROUP BY relation, member HAVING count(*) > 1) x UNION ALL SELECT 'checked' FROM {relations}) y GROUP BY problem",
        "SELECT * FROM (SELECT 'late evidence' AS problem, (SELECT count(*) FROM {inventory} WHERE date > DATE '2024-01-25') AS n UNION ALL SELECT 'unknown member', (SELECT count(*) FROM {relations} WHERE member NOT IN (SELECT ordinal FROM {products})) UNION ALL SELECT 'repeated member', (SELECT count(*) - count(DISTINCT (relation, member)) FROM {relations}) UNION ALL SELECT 'checked', (SELECT count(*) FROM {relations})) WHERE n > 0",
    ),
    "table_catalogue": (
        "SELECT 'inventory' AS name, count(*) AS n, CAST(max(date) AS STRING) AS latest FROM {inventory} UNION ALL SELECT 'event_log', count(*), CAST(max(ts) AS STRING) FROM {event_log} UNION ALL SELECT 'snapshots', count(*), CAST(max(l_orderkey) AS STRING) FROM {snapshots} UNION ALL SELECT 'weekly_plan', count(*), CAST(max(week) AS STRING) FROM {weekly_plan}",
        "SELECT 'inventory' AS name, (SELECT count(*) FROM {inventory}) AS n, (SELECT CAST(date AS VARCHAR) FROM {inventory} ORDER BY date DESC LIMIT 1) AS latest UNION ALL SELECT 'event_log', (SELECT count(*) FROM {events}), (SELECT CAST(ts AS VARCHAR) FROM {events} ORDER BY ts DESC LIMIT 1) UNION ALL SELECT 'snapshots', (SELECT count(*) FROM {lineitem}), (SELECT CAST(l_orderkey AS VARCHAR) FROM {lineitem} ORDER BY l_orderkey DESC LIMIT 1) UNION ALL SELECT 'weekly_plan', (SELECT 4 * count(*) FROM {supplier}), '4'",
    ),
}


def shop_ranking(v: Views) -> DataFrame:
    """Shops by the success rate of clicks, those without any last."""
    rates = v.sql("SELECT shop, count(CASE WHEN event = 'click_ok' THEN 1 END) / CAST(nullif(count(CASE WHEN event IN ('click_ok', 'click_deny') THEN 1 END), 0) AS DOUBLE) AS rate FROM {click_log} GROUP BY shop")
    return ordering.numbered(rates, F.desc_nulls_last("rate"), "shop", name="place").select("shop", F.round("rate", 6).alias("rate"), "place")


QUERIES = {name: (lambda v, text=text: v.sql(text)) for name, (text, _) in TEXTS.items()} | {"shop_ranking": shop_ranking}
SQL = {name: duck(text) for name, (_, text) in TEXTS.items()}
SQL["shop_ranking"] = duck("WITH r AS (SELECT shop, count(*) FILTER (event = 'click_ok') / nullif(count(*) FILTER (event IN ('click_ok', 'click_deny')), 0)::DOUBLE AS rate FROM {click_log} GROUP BY shop) SELECT shop, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate DESC NULLS LAST, shop) AS place FROM r")
