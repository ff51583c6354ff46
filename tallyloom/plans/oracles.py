"""DuckDB texts of round counts, events and merges that take another way than the shared ones: lists, correlated
subqueries and set operations instead of grouped joins and windows. They replace the shared text of their query."""

from __future__ import annotations

from tallyloom.plans.adapter import duck

_DONE = "status IN ('success', 'skipped')"
_LISTED = "EXISTS (SELECT 1 FROM {shop_offers} o WHERE o.round_id = s.round_id AND o.shop = s.shop AND o.offer = s.offer)"
_STEPS = "SELECT id, round_id, shop, event, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY round_id, shop ORDER BY id) AS n FROM {event_log}"
_NEXT = f"steps AS ({_STEPS}), pairs AS (SELECT a.id, a.round_id, a.shop, a.event, c.event AS next_event, abs(a.ms - b.ms) AS ms FROM steps a JOIN steps b ON b.round_id = a.round_id AND b.shop = a.shop AND b.n = a.n - 1 JOIN steps c ON c.round_id = a.round_id AND c.shop = a.shop AND c.n = a.n + 1 WHERE a.event <> 'verification_appear')"
_CARD = "coalesce(nullif(regexp_extract(note, 'idx=([0-9]+)', 1), ''), note)"
_MISSED = f"SELECT DISTINCT round_id, shop, {_CARD} AS card FROM {{click_log}} WHERE event IN ('click_no_popup', 'click_url_notoffer', 'click_deny') EXCEPT SELECT round_id, shop, {_CARD} FROM {{click_log}} WHERE event IN ('click_ok', 'click_skipped')"
_TIMED = "t AS (SELECT *, max(observed_at) OVER (PARTITION BY shop, date, machine) AS claim_at FROM {machine_inventory})"

SQL = {
    "top_values": """WITH b AS (SELECT p_size % 7 AS source, list(p_brand) AS all_ FROM part WHERE p_brand <> '' GROUP BY 1),
      o AS (SELECT source, list_sort(list_transform(map_entries(list_histogram(all_)), lambda e: {'n': -e.value::BIGINT, 'v': e.key})) AS kinds FROM b)
      SELECT source, e.v AS value, -e.n AS n FROM (SELECT source, unnest(kinds[1:5]) AS e FROM o) x UNION ALL SELECT source, '*', len(kinds) - 5 FROM o WHERE len(kinds) > 5""",
    "adopted_edges": duck("""WITH now AS (SELECT ordinal, name || '/' || image AS version FROM {products}), j AS (SELECT a.ordinal AS a, b.ordinal AS b, a.ordinal % 3 + 1 AS m, a.ordinal % 13 = 0 OR b.ordinal % 13 = 0 AS stale, a.ordinal % 9 = 0 AS other FROM now a JOIN now b ON b.ordinal = a.ordinal + 2)
      SELECT 'm' || m AS machine, count(*) FILTER (NOT stale AND NOT other) AS adopted, count(*) FILTER (stale AND NOT other) AS stale, count(*) FILTER (other) AS other_contract FROM j GROUP BY m"""),
    "round_tally": duck(f"""WITH keys AS (SELECT round_id, shop FROM {{shop_offers}} UNION SELECT round_id, shop FROM {{snapshots}}), l AS (SELECT s.*, {_LISTED} AS listed FROM {{snapshots}} s),
      d AS (SELECT round_id, shop, count(*) AS discovered FROM {{shop_offers}} GROUP BY ALL),
      c AS (SELECT round_id, shop, count(DISTINCT offer) FILTER (listed AND {_DONE}) AS handled, count(DISTINCT offer) FILTER (listed AND status = 'success') AS success_offers, count(DISTINCT (offer, sku)) FILTER (listed AND status = 'success') AS success_skus, count(DISTINCT offer) FILTER (NOT listed) AS orphans FROM l GROUP BY ALL)
      SELECT round_id, shop, coalesce(discovered, 0) AS discovered, coalesce(handled, 0) AS handled, coalesce(discovered, 0) - coalesce(handled, 0) AS failed, coalesce(success_offers, 0) AS success_offers, coalesce(success_skus, 0) AS success_skus, coalesce(orphans, 0) AS orphans
      FROM keys LEFT JOIN d USING (round_id, shop) LEFT JOIN c USING (round_id, shop)"""),
    "round_totals": duck(f"SELECT round_id, count(*) AS offers, count(*) FILTER ((round_id, shop, offer) IN (SELECT (round_id, shop, offer) FROM {{snapshots}} WHERE {_DONE})) AS handled FROM {{shop_offers}} GROUP BY round_id"),
    "orphans": duck("SELECT round_id, shop, offer FROM {snapshots} EXCEPT SELECT round_id, shop, offer FROM {shop_offers}"),
    "pending_offers": duck(f"""SELECT round_id, shop, offer, coalesce(len(tries), 0) - coalesce(len(tries), 0) + coalesce(list_max(tries), 0) AS attempts FROM {{shop_offers}} LEFT JOIN (SELECT round_id, shop, offer, list(attempt) AS tries, list(status) AS states FROM {{snapshots}} GROUP BY ALL) s USING (round_id, shop, offer)
      WHERE NOT coalesce(list_has_any(states, ['success', 'skipped']), false) AND coalesce(list_max(tries), 0) < 5"""),
    "declared_mismatch": duck("SELECT round_id, shop, declared, (SELECT count(*) FROM {shop_offers} o WHERE o.round_id = r.round_id AND o.shop = r.shop) AS listed FROM {shop_rounds} r WHERE declared <> (SELECT count(*) FROM {shop_offers} o WHERE o.round_id = r.round_id AND o.shop = r.shop)"),
    "coverage": duck("""WITH g AS (SELECT DISTINCT a.shop, b.date FROM {inventory} a, (SELECT DISTINCT date FROM {inventory}) b) SELECT shop, date, count(DISTINCT offer) AS offers, count(offer) AS skus FROM g LEFT JOIN (SELECT * FROM {inventory} WHERE stock IS NOT NULL) i USING (shop, date) GROUP BY shop, date"""),
    "failure_rate": duck(f"""WITH done AS (SELECT DISTINCT round_id, shop, offer FROM {{snapshots}} WHERE {_DONE}), c AS (SELECT round_id, count(*) AS cards FROM ({_MISSED}) GROUP BY round_id),
      o AS (SELECT round_id, count(*) AS n, count(*) - (SELECT count(*) FROM done JOIN {{shop_offers}} x USING (round_id, shop, offer) WHERE done.round_id = p.round_id) AS bad FROM {{shop_offers}} p GROUP BY round_id)
      SELECT round_id, n + coalesce(cards, 0) AS attempted, bad + coalesce(cards, 0) AS failed, round((bad + coalesce(cards, 0)) / (n + coalesce(cards, 0))::DOUBLE, 6) AS failure_rate, 10 * (bad + coalesce(cards, 0)) > n + coalesce(cards, 0) AS over_limit FROM o LEFT JOIN c USING (round_id)"""),
    "click_failures": duck(f"SELECT round_id, count(*) AS failed_cards FROM ({_MISSED}) GROUP BY round_id"),
    "click_reliability": duck("""WITH h AS (SELECT shop, histogram(event) AS m FROM {click_log} GROUP BY shop), c AS (SELECT shop, coalesce(m['click_ok'], 0)::BIGINT AS ok, coalesce(m['click_skipped'], 0)::BIGINT AS skipped, coalesce(m['click_no_popup'], 0)::BIGINT AS no_popup,
      (coalesce(m['click_url_notoffer'], 0) + coalesce(m['click_deny'], 0) + coalesce(m['click_parse_error'], 0))::BIGINT AS other FROM h) SELECT *, ok + skipped + no_popup + other AS attempted, round((ok + skipped) / (ok + skipped + no_popup + other)::DOUBLE, 6) AS success_rate, round(no_popup / (ok + skipped + no_popup + other)::DOUBLE, 6) AS no_popup_ratio FROM c"""),
    "deny_counts": duck("""SELECT round_id, shop, count(*) FILTER (event = 'deny_hit') + count(*) FILTER (event = 'click_deny' AND NOT EXISTS (SELECT 1 FROM {event_log} h WHERE h.round_id = e.round_id AND h.event = 'deny_hit' AND h.id < e.id)) AS denies FROM {event_log} e GROUP BY round_id, shop"""),
    "event_intervals": duck("""SELECT id, round_id, shop, ts, (SELECT max_by(p.ts, p.id) FROM {event_log} p WHERE p.round_id = e.round_id AND p.shop = e.shop AND p.id < e.id) AS prev_ts, epoch_us(ts) // 1000 - (SELECT epoch_us(max_by(p.ts, p.id)) // 1000 FROM {event_log} p WHERE p.round_id = e.round_id AND p.shop = e.shop AND p.id < e.id) AS interval_ms FROM {event_log} e"""),
    "interval_histogram": duck(f"""WITH {_NEXT}, b(bin, low, high) AS (VALUES ('<0.5s', 0, 500), ('0.5-1s', 500, 1000), ('1-2s', 1000, 2000), ('2-5s', 2000, 5000), ('5-10s', 5000, 10000), ('10-60s', 10000, 60000), ('>=60s', 60000, 9000000000000))
      SELECT bin, count(ms) AS events, count(*) FILTER (next_event = 'verification_appear') AS triggers, round(count(*) FILTER (next_event = 'verification_appear') / nullif(count(ms), 0)::DOUBLE, 6) AS rate FROM b LEFT JOIN pairs ON ms >= low AND ms < high GROUP BY bin"""),
    "delay_correlation": duck(f"""WITH {_NEXT}, p AS (SELECT round_id, ms::DOUBLE AS x, (next_event = 'verification_appear')::INT::DOUBLE AS y FROM pairs),
      r AS (SELECT *, (SELECT count(*) FILTER (q.x < p.x) + (count(*) FILTER (q.x = p.x) + 1) / 2.0 FROM p q WHERE q.round_id = p.round_id) AS rx, (SELECT count(*) FILTER (q.y < p.y) + (count(*) FILTER (q.y = p.y) + 1) / 2.0 FROM p q WHERE q.round_id = p.round_id) AS ry FROM p)
      SELECT round_id, count(*) AS n, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(x, y), 6) + 0.0 END AS pearson, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN round(corr(rx, ry), 6) + 0.0 END AS spearman FROM r GROUP BY round_id"""),
    "visits_since_pause": duck("""SELECT round_id, CASE WHEN idle_ms >= 3600000 THEN 0 ELSE visits END AS visits, idle_ms, idle_ms >= 3600000 AS idle_reset FROM (
      SELECT round_id, (SELECT count(*) FROM {pacing_log} v WHERE v.round_id = r.round_id AND v.event = 'pacing_visit' AND NOT EXISTS (SELECT 1 FROM {pacing_log} m WHERE m.round_id = r.round_id AND m.event IN ('pause', 'resume') AND m.id >= v.id)) AS visits,
        (SELECT epoch_us(date_trunc('day', ts) + INTERVAL '23:55' HOUR TO MINUTE) // 1000 - epoch_us(ts) // 1000 FROM {pacing_log} l WHERE l.round_id = r.round_id ORDER BY id DESC LIMIT 1) AS idle_ms FROM (SELECT DISTINCT round_id FROM {pacing_log}) r)""".replace("INTERVAL '23:55' HOUR TO MINUTE", "INTERVAL 1435 MINUTE")),
    "first_deny": duck("SELECT round_id, id, shop FROM {event_log} e WHERE event IN ('deny_hit', 'click_deny') AND NOT EXISTS (SELECT 1 FROM {event_log} x WHERE x.round_id = e.round_id AND x.event IN ('deny_hit', 'click_deny') AND x.id < e.id)"),
    "deny_window": duck("""WITH d AS (SELECT id, shop, epoch_us(ts) // 1000 AS ms FROM {event_log} WHERE event IN ('deny_hit', 'click_deny')) SELECT a.id, a.shop, count(*) AS in_window FROM d a JOIN d b ON b.shop = a.shop AND b.ms BETWEEN a.ms - 7200000 AND a.ms GROUP BY a.id, a.shop"""),
    "claims": duck("SELECT shop, date, list_max(list(observed_at || '|' || machine)) AS claim FROM (SELECT DISTINCT ON (shop, date, machine) shop, date, machine, observed_at FROM {machine_inventory} ORDER BY shop, date, machine, observed_at DESC) GROUP BY ALL"),
    "merged_inventory": duck(f"""WITH {_TIMED}, b AS (SELECT *, NOT EXISTS (SELECT 1 FROM t o WHERE o.shop = t.shop AND o.offer = t.offer AND o.sku = t.sku AND o.date = t.date AND (o.claim_at, o.machine) > (t.claim_at, t.machine)) AS best FROM t),
      f AS (SELECT DISTINCT ON (shop, offer, date) shop, offer, date, (sku = 'default') AS lone FROM t ORDER BY shop, offer, date, claim_at DESC, machine DESC, sku = 'default')
      SELECT shop, offer, sku, date, machine, stock FROM b JOIN f USING (shop, offer, date) WHERE best AND lone = (sku = 'default')"""),
    "merge_conflicts": duck(f"""WITH {_TIMED}, w AS (SELECT DISTINCT ON (shop, date) shop, date, machine AS winner FROM t ORDER BY shop, date, claim_at DESC, machine DESC)
      SELECT shop, date, winner, t.machine AS loser, count(*) AS n, count(*) FILTER (hit) AS replaced, count(*) FILTER (NOT hit) AS kept FROM (SELECT t.*, winner, EXISTS (SELECT 1 FROM {{machine_inventory}} k WHERE k.machine = winner AND k.shop = t.shop AND k.offer = t.offer AND k.sku = t.sku AND k.date = t.date) AS hit FROM t JOIN w USING (shop, date)) t WHERE winner <> t.machine GROUP BY ALL"""),
    "owned_rows": duck(f"""WITH {_TIMED}, l AS (SELECT *, max(claim_at) OVER (PARTITION BY shop, date) AS latest FROM t), o AS (SELECT shop, date, list_distinct(list(machine)) AS owners FROM l WHERE claim_at = latest GROUP BY ALL)
      SELECT machine, shop, date, count(*) AS n FROM {{machine_inventory}} JOIN o USING (shop, date) WHERE owners = [machine] GROUP BY ALL"""),
    "identity_merge": duck("SELECT DISTINCT ON (offer) offer, (SELECT min(date) FROM {machine_inventory} x WHERE x.offer = i.offer) AS first_seen, (SELECT max(date) FROM {machine_inventory} x WHERE x.offer = i.offer) AS last_seen, sku AS described FROM {machine_inventory} i ORDER BY offer, observed_at || '|' || machine || '|' || sku DESC"),
    "latest_success": duck("SELECT DISTINCT ON (round_id, shop, offer, sku) round_id, shop, offer, sku, price, attempt FROM {snapshots} WHERE status = 'success' ORDER BY round_id, shop, offer, sku, attempt DESC, l_orderkey DESC, price DESC, seen_at DESC"),
    "superseded_failures": duck("SELECT round_id, shop, offer, count(*) FILTER (status = 'failed') AS failures FROM {snapshots} GROUP BY ALL HAVING NOT list_contains(list(status), 'success') AND list_contains(list(status), 'failed')"),
    "latest_inventory": duck("SELECT shop, offer, sku, date, stock FROM {inventory} i WHERE date = (SELECT max(date) FROM {inventory} x WHERE x.shop = i.shop AND x.offer = i.offer AND x.sku = i.sku)"),
    "latest_form": duck("SELECT shop, offer, date, sku, stock FROM {inventory} i WHERE (sku = 'default') = (SELECT arg_max(x.sku = 'default', x.observed) FROM {inventory} x WHERE x.shop = i.shop AND x.offer = i.offer AND x.date = i.date)"),
    "attempt_budget": duck("SELECT round_id, shop, len(list_distinct(list(offer)))::BIGINT AS opportunities, list_max(list(attempt)) AS max_attempt, list_max(list(attempt)) + 1 AS next_attempt FROM {snapshots} GROUP BY ALL"),
    "round_elapsed": duck("""WITH e AS (SELECT round_id, shop, list_sort(list(epoch_us(ts) // 1000)) AS t FROM {event_log} GROUP BY ALL), g AS (SELECT round_id, shop, list_filter(list_zip(t[2:], t[:-2]), lambda p: p[1] - p[2] <= 1800000) AS steps, t FROM e),
      s AS (SELECT round_id, shop, coalesce(list_sum(list_transform(steps, lambda p: p[1] - p[2])), 0) AS ms, len(t) > 0 AND (len(t) = 1 OR t[2] - t[1] > 1800000 OR t[len(t)] - t[len(t) - 1] > 1800000 OR len(list_filter(range(2, len(t)), lambda i: t[i] - t[i - 1] > 1800000 AND t[i + 1] - t[i] > 1800000)) > 0) AS lone FROM g)
      SELECT r.round_id, count(s.shop) AS shops, CAST(sum(ms) AS BIGINT) AS elapsed_ms, CASE WHEN count(s.shop) = 0 THEN 'unrecorded' WHEN bool_or(lone) THEN 'lower_bound' ELSE 'complete' END AS quality FROM (SELECT DISTINCT round_id FROM {shop_rounds}) r LEFT JOIN s USING (round_id) GROUP BY r.round_id"""),
    "page_limits": duck("SELECT week, shop, CASE WHEN shop % 7 = 0 THEN 3 ELSE pages END AS pages FROM {weekly_plan}"),
    "plan_adjacency": duck("SELECT week, count(*) AS shops, count(*) FILTER (machine = (SELECT b.machine FROM {weekly_plan} b WHERE b.shop = a.shop AND b.week = a.week - 1)) AS repeated FROM {weekly_plan} a GROUP BY week"),
    "round_scope": duck("WITH s AS (SELECT round_id, string_agg(DISTINCT CAST(shop AS VARCHAR), ',' ORDER BY shop) AS scope FROM (SELECT DISTINCT round_id, shop FROM {shop_rounds}) GROUP BY round_id) SELECT scope, min(round_id) AS first_round, max(round_id) AS last_round, count(*) AS rounds FROM s GROUP BY scope".replace("DISTINCT CAST(shop AS VARCHAR)", "CAST(shop AS VARCHAR)")),
}
