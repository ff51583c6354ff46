"""Round counts, audits, event analyses, latest-wins and merge queries, as SQL that both engines run.

Each is one declarative plan over the adapter views: grouped scans, semi and anti joins, windows by key.
Where an identifier needs a total order, every window spells out its ties and where nulls go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import ordering
from tallyloom.plans.adapter import Views, duck

HANDLED = "status IN ('success', 'skipped')"
#: Bins of the interval histogram, in milliseconds: label, from.
BINS = "SELECT * FROM (VALUES ('<0.5s', 0), ('0.5-1s', 500), ('1-2s', 1000), ('2-5s', 2000), ('5-10s', 5000), ('10-60s', 10000), ('>=60s', 60000)) AS b(bin, low)"
_BIN = "CASE WHEN ms < 500 THEN 0 WHEN ms < 1000 THEN 500 WHEN ms < 2000 THEN 1000 WHEN ms < 5000 THEN 2000 WHEN ms < 10000 THEN 5000 WHEN ms < 60000 THEN 10000 ELSE 60000 END"
#: Outcomes of a clicked card: what got the offer, and what failed without one. A page that could not be parsed is neither.
GOT, MISSED = "event IN ('click_ok', 'click_skipped')", "event IN ('click_no_popup', 'click_url_notoffer', 'click_deny')"
_PAIRS = """
  SELECT *, row_number() OVER w - 1 AS seq, lead(event) OVER w AS next_event, EPOCHMS(ts) - lag(EPOCHMS(ts)) OVER w AS interval_ms
  FROM {event_log} WINDOW w AS (PARTITION BY round_id, shop ORDER BY id)"""
_CLAIMS = """
  SELECT shop, date, machine, max(observed_at) AS claim_at FROM {machine_inventory} GROUP BY shop, date, machine"""
_RANKED = f"""
  SELECT i.*, c.claim_at, CASE WHEN sku = 'default' THEN 1 ELSE 0 END AS form FROM {{machine_inventory}} i JOIN ({_CLAIMS}) c ON i.shop = c.shop AND i.date = c.date AND i.machine = c.machine"""

TEXTS = {
    # ---- round counts and audits
    # listed numbers are those of all snapshots less those of the orphans: one pass a side, no row is looked up
    "round_tally": f"""
      WITH seen AS (SELECT round_id, shop, offer, max(CASE WHEN {HANDLED} THEN 1 ELSE 0 END) AS done, max(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS won, count(DISTINCT CASE WHEN status = 'success' THEN sku END) AS skus FROM {{snapshots}} GROUP BY round_id, shop, offer),
      sides AS (SELECT round_id, shop, offer, 1 AS listed, 0 AS visited, 0 AS done, 0 AS won, 0 AS skus FROM {{shop_offers}} UNION ALL SELECT round_id, shop, offer, 0, 1, done, won, skus FROM seen),
      offers AS (SELECT round_id, shop, offer, max(listed) AS listed, max(visited) AS visited, max(done) AS done, max(won) AS won, max(skus) AS skus FROM sides GROUP BY round_id, shop, offer)
      SELECT round_id, shop, CAST(sum(listed) AS BIGINT) AS discovered, CAST(sum(listed * done) AS BIGINT) AS handled, CAST(sum(listed) - sum(listed * done) AS BIGINT) AS failed, CAST(sum(listed * won) AS BIGINT) AS success_offers,
        CAST(sum(listed * skus) AS BIGINT) AS success_skus, CAST(sum((1 - listed) * visited) AS BIGINT) AS orphans FROM offers GROUP BY round_id, shop""",
    # the sum of its shops' tallies
    "round_totals": f"""
      WITH seen AS (SELECT round_id, shop, offer, max(CASE WHEN {HANDLED} THEN 1 ELSE 0 END) AS done FROM {{snapshots}} GROUP BY round_id, shop, offer)
      SELECT round_id, CAST(sum(discovered) AS BIGINT) AS offers, CAST(sum(handled) AS BIGINT) AS handled FROM (
        SELECT o.round_id, o.shop, count(*) AS discovered, count(CASE WHEN s.done = 1 THEN 1 END) AS handled FROM {{shop_offers}} o LEFT JOIN seen s ON s.round_id = o.round_id AND s.shop = o.shop AND s.offer = o.offer GROUP BY o.round_id, o.shop) x GROUP BY round_id""",
    "orphans": """SELECT DISTINCT round_id, shop, offer FROM {snapshots} s WHERE NOT EXISTS (SELECT 1 FROM {shop_offers} o WHERE o.round_id = s.round_id AND o.shop = s.shop AND o.offer = s.offer)""",
    "pending_offers": f"""
      SELECT o.round_id, o.shop, o.offer, coalesce(a.attempts, 0) AS attempts FROM {{shop_offers}} o
      LEFT JOIN (SELECT round_id, shop, offer, max(attempt) AS attempts, max(CASE WHEN {HANDLED} THEN 1 ELSE 0 END) AS done FROM {{snapshots}} GROUP BY round_id, shop, offer) a
        ON a.round_id = o.round_id AND a.shop = o.shop AND a.offer = o.offer
      WHERE coalesce(a.done, 0) = 0 AND coalesce(a.attempts, 0) < 5""",
    "declared_mismatch": """
      SELECT r.round_id, r.shop, r.declared, count(o.offer) AS listed FROM {shop_rounds} r LEFT JOIN {shop_offers} o ON o.round_id = r.round_id AND o.shop = r.shop
      GROUP BY r.round_id, r.shop, r.declared HAVING r.declared <> count(o.offer)""",
    "coverage": """
      SELECT s.shop, d.date, coalesce(c.offers, 0) AS offers, coalesce(c.skus, 0) AS skus FROM (SELECT DISTINCT shop FROM {inventory}) s CROSS JOIN (SELECT DISTINCT date FROM {inventory}) d
      LEFT JOIN (SELECT shop, date, count(DISTINCT offer) AS offers, count(*) AS skus FROM {inventory} WHERE stock IS NOT NULL GROUP BY shop, date) c ON c.shop = s.shop AND c.date = d.date""",
    "attempt_budget": """SELECT round_id, shop, count(DISTINCT offer) AS opportunities, max(attempt) AS max_attempt, coalesce(max(attempt), 0) + 1 AS next_attempt FROM {snapshots} GROUP BY round_id, shop""",
    # offers that failed and cards that never gave one, among offers found and those cards
    "failure_rate": f"""
      WITH seen AS (SELECT round_id, shop, offer, max(CASE WHEN {HANDLED} THEN 1 ELSE 0 END) AS done FROM {{snapshots}} GROUP BY round_id, shop, offer),
      offers AS (SELECT o.round_id, count(*) AS discovered, count(CASE WHEN coalesce(s.done, 0) = 0 THEN 1 END) AS failed FROM {{shop_offers}} o LEFT JOIN seen s ON s.round_id = o.round_id AND s.shop = o.shop AND s.offer = o.offer GROUP BY o.round_id),
      cards AS (SELECT round_id, shop, coalesce(nullif(regexp_extract(note, 'idx=([0-9]+)', 1), ''), note) AS card, max(CASE WHEN {GOT} THEN 1 ELSE 0 END) AS ok, max(CASE WHEN {MISSED} THEN 1 ELSE 0 END) AS missed FROM {{click_log}} GROUP BY round_id, shop, coalesce(nullif(regexp_extract(note, 'idx=([0-9]+)', 1), ''), note)),
      clicks AS (SELECT round_id, count(*) AS n FROM cards WHERE missed = 1 AND ok = 0 GROUP BY round_id)
      SELECT o.round_id, discovered + coalesce(n, 0) AS attempted, failed + coalesce(n, 0) AS failed, round((failed + coalesce(n, 0)) / CAST(discovered + coalesce(n, 0) AS DOUBLE), 6) AS failure_rate, (failed + coalesce(n, 0)) / CAST(discovered + coalesce(n, 0) AS DOUBLE) > 0.1 AS over_limit
      FROM offers o LEFT JOIN clicks c ON c.round_id = o.round_id""",
    # two rounds may replace one another only if their sets of shops are equal
    "round_scope": """
      SELECT scope, min(round_id) AS first_round, max(round_id) AS last_round, count(*) AS rounds FROM (
        SELECT round_id, JOINED_SET(shop) AS scope FROM {shop_rounds} GROUP BY round_id) x GROUP BY scope""",
    "unique_name_lookup": """SELECT p_name || '/' || p_brand || '/' || CAST(p_size AS STRING) AS name, min(p_partkey) AS id FROM {part} GROUP BY p_name || '/' || p_brand || '/' || CAST(p_size AS STRING) HAVING count(DISTINCT p_partkey) = 1""",
    "round_shop_join": """SELECT r.round_id, count(*) AS shops, CAST(sum(declared) AS BIGINT) AS declared FROM (SELECT DISTINCT round_id FROM {snapshots}) r JOIN {shop_rounds} s ON s.round_id = r.round_id GROUP BY r.round_id""",
    "latest_week": """SELECT shop, machine FROM {weekly_plan} WHERE week = (SELECT max(week) FROM {weekly_plan})""",
    # ---- latest wins
    "latest_success": """
      SELECT round_id, shop, offer, sku, price, attempt FROM (
        SELECT *, row_number() OVER (PARTITION BY round_id, shop, offer, sku ORDER BY attempt DESC, l_orderkey DESC, price DESC, seen_at DESC) AS n FROM {snapshots} WHERE status = 'success') x WHERE n = 1""",
    "superseded_failures": """
      SELECT round_id, shop, offer, count(*) AS failures FROM {snapshots} f WHERE status = 'failed' AND NOT EXISTS (SELECT 1 FROM {snapshots} s WHERE s.status = 'success' AND s.round_id = f.round_id AND s.shop = f.shop AND s.offer = f.offer) GROUP BY round_id, shop, offer""",
    "latest_inventory": """
      SELECT shop, offer, sku, date, stock FROM (SELECT *, row_number() OVER (PARTITION BY shop, offer, sku ORDER BY date DESC) AS n FROM {inventory}) x WHERE n = 1""",
    "sku_dimension": """SELECT offer, sku, min(date) AS first_seen, max(date) AS last_seen, max_by(price, CASE WHEN price IS NOT NULL THEN observed END) AS price FROM {inventory} GROUP BY offer, sku""",
    "product_upsert": """
      SELECT l_partkey AS offer, max_by(name, (l_orderkey * 8 + attempt) * 10000000 + price) AS name FROM (
        SELECT offer AS l_partkey, l_orderkey, attempt, price, CASE WHEN attempt % 3 = 0 THEN NULL ELSE 'n' || CAST(round_id AS STRING) END AS name FROM {snapshots}) x WHERE name IS NOT NULL GROUP BY l_partkey""",
    "latest_form": """
      SELECT shop, offer, date, sku, stock FROM (
        SELECT *, first_value(CASE WHEN sku = 'default' THEN 1 ELSE 0 END) OVER (PARTITION BY shop, offer, date ORDER BY observed DESC) AS form FROM {inventory}) x
      WHERE form = CASE WHEN sku = 'default' THEN 1 ELSE 0 END""",
    "as_of_version": """
      SELECT offer, sku, max_by(stock, CASE WHEN stock IS NOT NULL THEN date END) AS stock, max(date) AS as_of FROM {inventory} WHERE date <= DATE '2024-01-15' GROUP BY offer, sku""",
    "best_evidence": """
      SELECT offer, max_by(source, k) AS source, max_by(stock, CASE WHEN stock IS NOT NULL THEN k END) AS stock, max(k) AS k FROM (
        SELECT offer, 'batch' AS source, stock, observed * 2 + 1 AS k FROM {inventory} WHERE observed % 3 = 0
        UNION ALL SELECT offer, 'snapshot' AS source, stock, observed * 2 AS k FROM {inventory} WHERE observed % 3 <> 0) x GROUP BY offer""",
    "identity_ledger": """SELECT coalesce(sku, '') AS sku, coalesce(offer, '') AS offer, min(observed) AS id, count(*) AS n FROM {inventory} GROUP BY coalesce(sku, ''), coalesce(offer, '')""",
    "attempt_loop": """SELECT round_id, shop, offer, max(n) AS attempts, max(CASE WHEN n <= 3 AND status = 'success' THEN 1 ELSE 0 END) AS within_three FROM (
        SELECT *, row_number() OVER (PARTITION BY round_id, shop, offer ORDER BY attempt, l_orderkey, price, sku, seen_at) AS n FROM {snapshots}) x GROUP BY round_id, shop, offer""",
    # ---- events
    "deny_counts": """
      WITH b AS (SELECT round_id, min(id) AS first_hit FROM {event_log} WHERE event = 'deny_hit' GROUP BY round_id)
      SELECT e.round_id, e.shop, count(CASE WHEN event = 'deny_hit' OR event = 'click_deny' AND (first_hit IS NULL OR id < first_hit) THEN 1 END) AS denies FROM {event_log} e LEFT JOIN b ON b.round_id = e.round_id GROUP BY e.round_id, e.shop""",
    "click_failures": f"""
      SELECT round_id, count(*) AS failed_cards FROM (SELECT round_id, shop, coalesce(nullif(regexp_extract(note, 'idx=([0-9]+)', 1), ''), note) AS card, max(CASE WHEN {GOT} THEN 1 ELSE 0 END) AS ok, max(CASE WHEN {MISSED} THEN 1 ELSE 0 END) AS failed
        FROM {{click_log}} GROUP BY round_id, shop, coalesce(nullif(regexp_extract(note, 'idx=([0-9]+)', 1), ''), note)) x WHERE failed = 1 AND ok = 0 GROUP BY round_id""",
    "click_reliability": """
      SELECT shop, ok, skipped, no_popup, other, ok + skipped + no_popup + other AS attempted, round((ok + skipped) / CAST(nullif(ok + skipped + no_popup + other, 0) AS DOUBLE), 6) AS success_rate, round(no_popup / CAST(nullif(ok + skipped + no_popup + other, 0) AS DOUBLE), 6) AS no_popup_ratio FROM (
        SELECT shop, count(CASE WHEN event = 'click_ok' THEN 1 END) AS ok, count(CASE WHEN event = 'click_skipped' THEN 1 END) AS skipped, count(CASE WHEN event = 'click_no_popup' THEN 1 END) AS no_popup,
          count(CASE WHEN event IN ('click_url_notoffer', 'click_deny', 'click_parse_error') THEN 1 END) AS other FROM {click_log} GROUP BY shop) x""",
    "event_intervals": """
      SELECT id, round_id, shop, ts, lag(ts) OVER w AS prev_ts, EPOCHMS(ts) - lag(EPOCHMS(ts)) OVER w AS interval_ms FROM {event_log} WINDOW w AS (PARTITION BY round_id, shop ORDER BY id)""",
    "next_event_pairs": f"""
      SELECT id, round_id, coalesce(shop, '<none>') AS shop, CAST(seq AS BIGINT) AS seq, event, next_event, interval_ms FROM ({_PAIRS}) p WHERE event <> 'verification_appear' AND interval_ms IS NOT NULL AND next_event IS NOT NULL""",
    "interval_histogram": f"""
      SELECT b.bin, coalesce(n, 0) AS events, coalesce(t, 0) AS triggers, round(t / CAST(nullif(n, 0) AS DOUBLE), 6) AS rate
      FROM ({BINS}) b LEFT JOIN (SELECT {_BIN} AS low, count(*) AS n, count(CASE WHEN next_event = 'verification_appear' THEN 1 END) AS t
        FROM (SELECT abs(interval_ms) AS ms, next_event FROM ({_PAIRS}) q WHERE event <> 'verification_appear' AND next_event IS NOT NULL AND interval_ms IS NOT NULL) p GROUP BY {_BIN}) h ON h.low = b.low""",
    "delay_correlation": f"""
      WITH p AS (SELECT id, round_id, CAST(abs(interval_ms) AS DOUBLE) AS x, CASE WHEN next_event = 'verification_appear' THEN 1.0 ELSE 0.0 END AS y FROM ({_PAIRS}) q WHERE event <> 'verification_appear' AND interval_ms IS NOT NULL AND next_event IS NOT NULL),
      r AS (SELECT *, rank() OVER (PARTITION BY round_id ORDER BY x) + (count(*) OVER (PARTITION BY round_id, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY round_id ORDER BY y) + (count(*) OVER (PARTITION BY round_id, y) - 1) / 2.0 AS ry FROM p)
      SELECT round_id, count(*) AS n, CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) + CAST(0 AS DOUBLE) END AS pearson,
        CASE WHEN count(*) >= 2 AND min(x) < max(x) AND min(y) < max(y) THEN round(covar_pop(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)) / nullif(stddev_pop(CAST(rx AS DOUBLE)) * stddev_pop(CAST(ry AS DOUBLE)), 0), 6) + CAST(0 AS DOUBLE) END AS spearman FROM r GROUP BY round_id""",
    "verification_counts": """SELECT round_id, shop, phase, hour(ts + INTERVAL '8' HOUR) AS local_hour, count(*) AS n FROM {event_log} WHERE event = 'verification_appear' GROUP BY round_id, shop, phase, hour(ts + INTERVAL '8' HOUR)""",
    # visits after the round's last pause or resume; none if the round then lay idle for an hour before the log's end
    "visits_since_pause": """
      SELECT r.round_id, CASE WHEN idle_ms >= 3600000 THEN 0 ELSE visits END AS visits, idle_ms, idle_ms >= 3600000 AS idle_reset FROM (
        SELECT e.round_id, count(CASE WHEN event = 'pacing_visit' AND id > coalesce(marker, 0) THEN 1 END) AS visits, max_by(EPOCHMS(day_end), id) - max_by(EPOCHMS(ts), id) AS idle_ms FROM {pacing_log} e
        JOIN (SELECT round_id, max(CASE WHEN event IN ('pause', 'resume') THEN id END) AS marker FROM {pacing_log} GROUP BY round_id) m ON m.round_id = e.round_id GROUP BY e.round_id) r""",
    "deny_window": """
      SELECT id, shop, count(*) OVER (PARTITION BY shop ORDER BY EPOCHMS(ts) RANGE BETWEEN 7200000 PRECEDING AND CURRENT ROW) AS in_window FROM {event_log} WHERE event IN ('deny_hit', 'click_deny')""",
    "first_deny": """SELECT round_id, min(id) AS id, min_by(shop, id) AS shop FROM {event_log} WHERE event IN ('deny_hit', 'click_deny') GROUP BY round_id""",
    "pause_quota": """SELECT id, round_id, CAST(floor(row_number() OVER (PARTITION BY round_id, shop ORDER BY id) / 10.0) AS BIGINT) AS pauses FROM {event_log} WHERE event = 'popup_open'""",
    "daily_dedupe": """SELECT shop, user_id, CAST(ts AS DATE) AS date, min(id) AS id, count(*) AS seen FROM {event_log} WHERE event = 'popup_open' GROUP BY shop, user_id, CAST(ts AS DATE)""",
    "budget_slots": """
      SELECT round_id, shop, user_id, slot FROM (SELECT round_id, shop, user_id, row_number() OVER (PARTITION BY round_id, shop ORDER BY min(id)) AS slot FROM {event_log} WHERE event = 'popup_open' GROUP BY round_id, shop, user_id) x WHERE slot <= 5""",
    "round_outcome": """SELECT round_id, coalesce(min_by(event, id) FILTER (WHERE event IN ('deny_hit', 'click_deny')), 'finished') AS reason, max(id) AS last_id FROM {event_log} GROUP BY round_id""",
    "shop_spans": """SELECT round_id, shop, min(ts) AS first_ts, max(ts) AS last_ts, max(EPOCHMS(ts)) - min(EPOCHMS(ts)) AS span_ms FROM {event_log} GROUP BY round_id, shop""",
    "current_shop": """SELECT round_id, max_by(shop, id) AS shop FROM {event_log} GROUP BY round_id""",
    "elapsed_sessions": """
      SELECT shop, session, count(*) AS events, max(ms) - min(ms) AS elapsed_ms, CASE WHEN count(*) = 1 THEN 'lower_bound' WHEN bool_or(event = 'verification_appear') THEN 'recorded' ELSE 'complete' END AS quality
      FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY shop ORDER BY ms, id) AS BIGINT) AS session FROM (
        SELECT *, EPOCHMS(ts) AS ms, CASE WHEN EPOCHMS(ts) - lag(EPOCHMS(ts)) OVER (PARTITION BY shop ORDER BY EPOCHMS(ts), id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM {event_log}) x) y GROUP BY shop, session""",
    "event_decode": """
      SELECT id, CAST(regexp_extract(note, 'page=([0-9]+)', 1) AS BIGINT) AS page, CAST(regexp_extract(note, 'idx=([0-9]+)', 1) AS BIGINT) AS idx, CASE WHEN event LIKE 'click%' THEN 'click' WHEN event LIKE '%deny%' THEN 'deny' ELSE 'other' END AS kind FROM {event_log}""",
    "stage_projection": f"""
      SELECT r.round_id, r.shop, CASE WHEN listed IS NULL THEN 'listing' WHEN pending > 0 THEN 'detail' ELSE 'done' END AS stage FROM {{shop_rounds}} r
      LEFT JOIN (SELECT o.round_id, o.shop, count(*) AS listed, count(CASE WHEN s.offer IS NULL THEN 1 END) AS pending FROM {{shop_offers}} o
        LEFT JOIN (SELECT DISTINCT round_id, shop, offer FROM {{snapshots}} WHERE {HANDLED}) s ON s.round_id = o.round_id AND s.shop = o.shop AND s.offer = o.offer GROUP BY o.round_id, o.shop) p ON p.round_id = r.round_id AND p.shop = r.shop""",
    # ---- exchange and merge
    "iso_weeks": """SELECT date, CAST(ISOYEAR(date) AS STRING) || '-W' || lpad(CAST(weekofyear(date) AS STRING), 2, '0') AS week, count(*) AS n FROM {inventory} GROUP BY date""",
    "claims": f"""SELECT shop, date, max(claim_at || '|' || machine) AS claim FROM ({_CLAIMS}) c GROUP BY shop, date""",
    "merged_inventory": f"""
      SELECT shop, offer, sku, date, machine, stock FROM (
        SELECT *, row_number() OVER (PARTITION BY shop, offer, sku, date ORDER BY claim_at DESC, machine DESC) AS n, first_value(form) OVER (PARTITION BY shop, offer, date ORDER BY claim_at DESC, machine DESC, form) AS winning FROM ({_RANKED}) r) x
      WHERE n = 1 AND form = winning""",
    # of a (shop, day) that several machines claim: who wins, and how many rows of the others go or stay
    "merge_conflicts": f"""
      SELECT shop, date, winner, machine AS loser, count(*) AS n, count(CASE WHEN replaced THEN 1 END) AS replaced, count(CASE WHEN NOT replaced THEN 1 END) AS kept FROM (
        SELECT r.shop, r.date, r.machine, w.winner, k.offer IS NOT NULL AS replaced FROM ({_RANKED}) r
        JOIN (SELECT shop, date, max_by(machine, claim_at || '|' || machine) AS winner, count(*) AS n FROM ({_CLAIMS}) c GROUP BY shop, date) w ON w.shop = r.shop AND w.date = r.date AND w.winner <> r.machine
        LEFT JOIN {{machine_inventory}} k ON k.machine = w.winner AND k.shop = r.shop AND k.offer = r.offer AND k.sku = r.sku AND k.date = r.date) x GROUP BY shop, date, winner, machine""",
    "identity_merge": """
      SELECT offer, min(date) AS first_seen, max(date) AS last_seen, max_by(sku, observed_at || '|' || machine || '|' || sku) AS described FROM {machine_inventory} GROUP BY offer""",
    "image_union": """SELECT DISTINCT offer, sku, stock FROM {machine_inventory}""",
    # a machine sends its rows unless another's claim stands at the very time of the group's latest observation
    "owned_rows": f"""
      SELECT i.machine, i.shop, i.date, count(*) AS n FROM {{machine_inventory}} i WHERE NOT EXISTS (
        SELECT 1 FROM ({_CLAIMS}) c JOIN (SELECT shop, date, max(observed_at) AS latest FROM {{machine_inventory}} GROUP BY shop, date) v ON v.shop = c.shop AND v.date = c.date AND v.latest = c.claim_at
        WHERE c.shop = i.shop AND c.date = i.date AND c.machine <> i.machine) GROUP BY i.machine, i.shop, i.date""",
    # of every row, in any order: the parts of the rows' hashes are added up
    "table_digest": """
      SELECT machine, count(*) AS n, CAST(sum(HEX7(substring(h, 1, 7))) AS BIGINT) AS part1, CAST(sum(HEX7(substring(h, 8, 7))) AS BIGINT) AS part2, CAST(sum(HEX7(substring(h, 15, 7))) AS BIGINT) AS part3 FROM (
        SELECT machine, md5(shop || '|' || offer || '|' || sku || '|' || CAST(date AS STRING) || '|' || coalesce(CAST(stock AS STRING), '')) AS h FROM {machine_inventory}) x GROUP BY machine""",
    "table_difference": """
      SELECT side, count(*) AS n FROM (
        SELECT 'only_m1' AS side, shop, offer, sku, date FROM (SELECT shop, offer, sku, date FROM {machine_inventory} WHERE machine = 'm1' EXCEPT ALL SELECT shop, offer, sku, date FROM {machine_inventory} WHERE machine = 'm2') a
        UNION ALL SELECT 'only_m2' AS side, shop, offer, sku, date FROM (SELECT shop, offer, sku, date FROM {machine_inventory} WHERE machine = 'm2' EXCEPT ALL SELECT shop, offer, sku, date FROM {machine_inventory} WHERE machine = 'm1') b) x GROUP BY side""",
    "multiset_overlap": """SELECT offer, count(*) AS n FROM (SELECT offer, date FROM {machine_inventory} WHERE machine = 'm1' INTERSECT ALL SELECT offer, date FROM {machine_inventory} WHERE machine = 'm2') x GROUP BY offer""",
    "coverage_gaps": """
      SELECT machine, shop, count(*) AS missing_days, count(*) = (SELECT count(DISTINCT date) FROM {machine_inventory}) AS whole_range FROM (
        SELECT m.machine, m.shop, d.date FROM (SELECT DISTINCT machine, 'S' || CAST(shop % 14 AS STRING) AS shop FROM {weekly_plan}) m CROSS JOIN (SELECT DISTINCT date FROM {machine_inventory}) d
        EXCEPT SELECT machine, shop, date FROM {machine_inventory}) g GROUP BY machine, shop""",
    "plan_deviations": """
      SELECT w.week, s.round_id, s.shop, CASE WHEN w.machine IS NULL THEN 'out_of_plan' WHEN s.declared > w.pages THEN 'overreach' ELSE 'planned' END AS deviation FROM {shop_rounds} s LEFT JOIN {weekly_plan} w ON w.shop = s.shop AND w.week = s.round_id % 4 + 1""",
    "package_roster": """
      SELECT coalesce(p.machine, a.machine) AS machine, CASE WHEN a.machine IS NULL THEN 'missing' WHEN p.machine IS NULL THEN 'unexpected' ELSE 'present' END AS state, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT machine FROM {weekly_plan} UNION SELECT 'm9') p FULL OUTER JOIN (SELECT machine, count(*) AS n FROM {machine_inventory} GROUP BY machine) a ON a.machine = p.machine""",
    "id_sources": """SELECT offer FROM {inventory} WHERE date = DATE '2024-01-10' UNION SELECT CAST(user_id AS STRING) FROM {event_log} WHERE round_id = 10 UNION SELECT CAST(offer AS STRING) FROM {snapshots} WHERE round_id = 3""",
    # time spent in a round: sessions of its events (a break of half an hour ends one), by shop of the round
    "round_elapsed": """
      SELECT r.round_id, count(DISTINCT g.shop) AS shops, CAST(sum(ms) AS BIGINT) AS elapsed_ms, CASE WHEN count(g.shop) = 0 THEN 'unrecorded' WHEN min(n) = 1 THEN 'lower_bound' ELSE 'complete' END AS quality FROM (SELECT DISTINCT round_id FROM {shop_rounds}) r LEFT JOIN (
        SELECT round_id, shop, session, max(ms) - min(ms) AS ms, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY round_id, shop ORDER BY ms, id) AS session FROM (
          SELECT *, EPOCHMS(ts) AS ms, CASE WHEN EPOCHMS(ts) - lag(EPOCHMS(ts)) OVER (PARTITION BY round_id, shop ORDER BY EPOCHMS(ts), id) <= 1800000 THEN 0 ELSE 1 END AS fresh FROM {event_log}) x) y GROUP BY round_id, shop, session) g ON g.round_id = r.round_id GROUP BY r.round_id""",
    # ---- plan
    "plan_load": """SELECT machine, CAST(sum(pages) AS BIGINT) AS pages, count(DISTINCT shop) AS shops FROM {weekly_plan} WHERE week > (SELECT max(week) FROM {weekly_plan}) - 3 GROUP BY machine""",
    "plan_adjacency": """SELECT week, count(*) AS shops, count(CASE WHEN machine = before THEN 1 END) AS repeated FROM (SELECT *, lag(machine) OVER (PARTITION BY shop ORDER BY week) AS before FROM {weekly_plan}) x GROUP BY week""",
    "page_limits": """SELECT week, shop, coalesce(CASE WHEN shop % 7 = 0 THEN 3 END, pages, nullif(shop % 2, 0), 10) AS pages FROM {weekly_plan}""",
    # ---- histograms and ledgers
    "top_values": """
      WITH k AS (SELECT source, value, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, value) AS place FROM (SELECT p_size % 7 AS source, p_brand AS value, count(*) AS n FROM {part} WHERE p_brand <> '' GROUP BY p_size % 7, p_brand) a)
      SELECT source, value, n FROM k WHERE place <= 5 UNION ALL SELECT source, '*', max(place) - 5 FROM k GROUP BY source HAVING max(place) > 5""",
    "outcome_lattice": """SELECT round_id, greatest(2 * max(CASE WHEN event = 'deny_hit' THEN 1 ELSE 0 END), max(CASE WHEN event = 'click_deny' THEN 1 ELSE 0 END)) AS outcome FROM {event_log} GROUP BY round_id""",
}

QUERIES = {name: (lambda v, text=text: v.sql(text)) for name, text in TEXTS.items()}
SQL = {name: duck(text) for name, text in TEXTS.items()}

QUERIES["review_pages"] = lambda v: ordering.numbered(v.sql("SELECT offer, count(*) AS n FROM {inventory} GROUP BY offer"), F.desc("n"), "offer").select("offer", "rn", F.ceil(F.col("rn") / 20).alias("page"))
SQL["review_pages"] = duck("SELECT offer, rn, CAST(ceil(rn / 20.0) AS BIGINT) AS page FROM (SELECT offer, row_number() OVER (ORDER BY n DESC, offer) AS rn FROM (SELECT offer, count(*) AS n FROM {inventory} GROUP BY offer) a) b")


def _bucketed(rows: DataFrame, width: int, side: int) -> DataFrame:
    """Rows in their stretch of time of this width (ms), and once more, not as their own, in the stretch after it (side 1) or before it
    (side -1): so what lies within a width of a row, on one side, is with it, and no group is longer than two stretches."""
    at = F.floor(F.col("ms") / width)
    return rows.withColumn("_in", F.explode(F.array(F.struct(at.alias("bucket"), F.lit(True).alias("own")), F.struct((at + side).alias("bucket"), F.lit(False).alias("own"))))).select("*", "_in.bucket", "_in.own").drop("_in")


_TIMED = "SELECT id, shop, event, EPOCHMS(ts) AS ms FROM {event_log}"


def deny_window(v: Views) -> DataFrame:
    """For each denial, how many its shop had in the two hours up to it."""
    rows = _bucketed(v.sql(_TIMED + " WHERE event IN ('deny_hit', 'click_deny')"), 7_200_000, 1)
    window = Window.partitionBy("shop", "bucket").orderBy("ms").rangeBetween(-7_200_000, Window.currentRow)
    return rows.withColumn("in_window", F.count("id").over(window)).where("own").select("id", "shop", "in_window")


def elapsed_sessions(v: Views) -> DataFrame:
    """A shop's sessions: runs of events without a gap of over half an hour."""
    rows = _bucketed(v.sql(_TIMED), 1_800_000, 1)
    before = F.lag("ms").over(Window.partitionBy("shop", "bucket").orderBy("ms", "id"))
    marked = rows.withColumn("fresh", F.when(F.col("ms") - before <= 1_800_000, 0).otherwise(1)).where("own").select("id", "shop", "event", "ms", "fresh")
    numbered = ordering.running(marked, ["ms", "id"], {"_before": F.col("fresh")}, ("shop",)).withColumn("session", F.col("_before") + F.col("fresh"))
    quality = F.when(F.count("id") == 1, "lower_bound").when(F.bool_or(F.col("event") == "verification_appear"), "recorded").otherwise("complete")
    return numbered.groupBy("shop", "session").agg(F.count("id").alias("events"), (F.max("ms") - F.min("ms")).alias("elapsed_ms"), quality.alias("quality"))


def pause_accounting(v: Views) -> DataFrame:
    """How long verifications held each shop up: to the next event, ten minutes at most; those that are the shop's last event go on."""
    log = v.sql(_TIMED)
    rows = _bucketed(log, 600_000, -1)
    after = F.lead("ms").over(Window.partitionBy("shop", "bucket").orderBy("ms", "id"))
    held = rows.withColumn("ms_held", F.least(F.coalesce(after - F.col("ms"), F.lit(600_000)), F.lit(600_000))).where("own AND event = 'verification_appear'")
    last = log.groupBy("shop").agg(F.max(F.struct("ms", "id"))["id"].alias("last"))
    open_ = F.col("id") == F.col("last")
    out = held.join(last, "shop").groupBy("shop").agg(F.sum(F.when(open_, 0).otherwise(F.col("ms_held"))).alias("paused_ms"), F.count_if(open_).alias("ongoing"))
    return out.select("shop", F.col("paused_ms").cast("long").alias("paused_ms"), "ongoing")


QUERIES |= {"deny_window": deny_window, "elapsed_sessions": elapsed_sessions}
