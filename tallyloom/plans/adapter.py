"""Domain views over the given tables, in SQL that Spark and DuckDB both run.

Each text names its inputs in braces; ``Views.sql`` binds them as DataFrames, ``duck`` spells them out as
common table expressions. ``EPOCHMS(x)`` stands for milliseconds since 1970 and ``ISOYEAR(x)`` for the
year of a date's ISO week, ``JOINED_SET(x)`` for a group's sorted distinct values, ``HEX7(x)`` for the number
that seven hex digits spell, in either engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # a daily stock series: the last event of a day counts, some without a readable stock; some offers switch
    # to a single default SKU
    "inventory": """
        SELECT shop, offer, sku, date, event_id AS observed, CAST(floor(value) AS BIGINT) AS stock, value AS price
        FROM (SELECT *, row_number() OVER (PARTITION BY shop, offer, sku, date ORDER BY event_id DESC) AS nth FROM (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE value END AS value, 'S' || CAST(user_id % 12 AS STRING) AS shop, CAST(user_id AS STRING) AS offer, CAST(ts AS DATE) AS date,
            CASE WHEN user_id % 3 = 0 AND day(CAST(ts AS DATE)) BETWEEN 11 AND 17 THEN 'default' ELSE event_type END AS sku
          FROM {events}) x) y WHERE nth = 1""",
    "event_log": """
        SELECT event_id AS id, day(ts) AS round_id, 'S' || CAST(user_id % 12 AS STRING) AS shop,
          CASE event_type WHEN 'view' THEN 'popup_open' WHEN 'click' THEN 'click_ok' WHEN 'signup' THEN 'click_deny' WHEN 'purchase' THEN 'deny_hit' ELSE 'verification_appear' END AS event,
          CASE WHEN event_id % 2 = 0 THEN 'listing' ELSE 'detail' END AS phase, ts,
          'page=' || CAST(event_id % 7 AS STRING) || '&idx=' || CAST(event_id % 30 AS STRING) AS note, user_id
        FROM {events}""",
    # clicked cards with all their outcomes
    "click_log": """
        SELECT event_id AS id, day(ts) AS round_id, 'S' || CAST(user_id % 12 AS STRING) AS shop,
          CASE WHEN event_id % 97 = 0 THEN 'click_parse_error' WHEN event_id % 9 = 0 THEN 'click_skipped' WHEN event_id % 5 = 0 THEN 'click_url_notoffer' WHEN event_type = 'click' THEN 'click_ok' WHEN event_type IN ('signup', 'view') THEN 'click_deny' ELSE 'click_no_popup' END AS event,
          CASE WHEN event_id % 113 = 0 THEN 'no place' ELSE 'page=' || CAST(event_id % 7 AS STRING) || '&idx=' || CAST(event_id % 60 AS STRING) END AS note
        FROM {events}""",
    # visits, pauses and resumptions of rounds; a round is a day
    "pacing_log": """
        SELECT event_id AS id, day(ts) AS round_id, CASE WHEN event_id % 53 = 0 THEN 'pause' WHEN event_id % 53 = 3 THEN 'resume' WHEN event_type = 'error' THEN 'other' ELSE 'pacing_visit' END AS event, ts, date_trunc('day', ts) + INTERVAL '24' HOUR - INTERVAL '5' MINUTE AS day_end
        FROM {events} WHERE day(ts) % 3 <> 0 OR hour(ts) < 20""",
    "snapshots": """
        SELECT l_orderkey % 20 AS round_id, l_suppkey % 12 AS shop, l_partkey AS offer, CAST(l_quantity AS BIGINT) AS sku, CAST(l_linenumber AS BIGINT) AS attempt,
          CASE l_returnflag WHEN 'N' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status, l_extendedprice AS price, l_orderkey, l_shipdate AS seen_at
        FROM {lineitem}""",
    # the listing; what was visited without being listed is an orphan: here the last lines of the longest orders
    "shop_offers": """SELECT DISTINCT round_id, shop, offer FROM {snapshots} WHERE attempt <= 6""",
    "shop_rounds": """
        SELECT round_id, shop, count(*) + CASE WHEN (round_id * 7 + shop) % 10 = 0 THEN 1 ELSE 0 END AS declared FROM {shop_offers} GROUP BY round_id, shop""",
    # observations of several machines: each has a third of the rows, and some of its neighbour's
    "machine_inventory": """
        SELECT 'm' || CAST(m AS STRING) AS machine, shop, offer, sku, date, max(ts) AS observed_at, max(event_id) AS observed, CAST(floor(max_by(value, event_id)) AS BIGINT) AS stock
        FROM (
          SELECT event_id % 3 + 1 AS m, event_id, value, CAST(ts AS STRING) AS ts, 'S' || CAST(user_id % 12 AS STRING) AS shop, CAST(user_id AS STRING) AS offer, CAST(ts AS DATE) AS date,
            CASE WHEN (user_id + event_id % 3) % 4 = 0 THEN 'default' ELSE event_type END AS sku FROM {events} WHERE value IS NOT NULL
          UNION ALL
          SELECT (event_id + 1) % 3 + 1 AS m, event_id, value + 1 AS value, CAST(ts AS STRING) AS ts, 'S' || CAST(user_id % 12 AS STRING) AS shop, CAST(user_id AS STRING) AS offer, CAST(ts AS DATE) AS date,
            CASE WHEN (user_id + (event_id + 1) % 3) % 4 = 0 THEN 'default' ELSE event_type END AS sku FROM {events} WHERE event_id % 5 = 0 AND value IS NOT NULL) x
        GROUP BY m, shop, offer, sku, date""",
    # items for matching, in the order of their ids; images repeat
    "products": """
        SELECT p_partkey AS ordinal, 'S' || CAST(p_partkey % 12 AS STRING) AS shop, CAST(p_partkey AS STRING) AS offer, p_name || ' ' || p_brand AS name, p_partkey % 520 AS image, p_type AS source FROM {part} WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL""",
    # what machines hold together: runs of three neighbours, and some pairs across them; some members were recorded
    # with other evidence than today's, some are not among today's products
    "relations": """
        SELECT relation, machine, confirmed, member, version FROM (
          SELECT 'r' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) AS STRING) AS relation, 'm' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) % 3 + 1 AS STRING) AS machine, CAST(floor(ordinal / 3.0) AS BIGINT) % 4 <> 0 AS confirmed, ordinal AS member, CASE WHEN ordinal % 13 = 0 THEN 'old' ELSE name || '/' || CAST(image AS STRING) END AS version
          FROM {products} WHERE CAST(floor(ordinal / 3.0) AS BIGINT) % 5 <> 0
          UNION ALL
          SELECT 's' || CAST(CAST(floor(ordinal / 2.0) AS BIGINT) AS STRING), 'm' || CAST(CAST(floor(ordinal / 2.0) AS BIGINT) % 3 + 1 AS STRING), CAST(floor(ordinal / 2.0) AS BIGINT) % 7 <> 0, ordinal, name || '/' || CAST(image AS STRING)
          FROM {products} WHERE CAST(floor(ordinal / 2.0) AS BIGINT) % 4 = 0
          UNION ALL
          SELECT 'u' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) AS STRING), 'm' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) % 2 + 2 AS STRING), true, ordinal, name || '/' || CAST(image AS STRING)
          FROM {products} WHERE CAST(floor(ordinal / 3.0) AS BIGINT) % 10 = 1
          UNION ALL
          SELECT 'r' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) AS STRING), 'm' || CAST(CAST(floor(ordinal / 3.0) AS BIGINT) % 3 + 1 AS STRING), CAST(floor(ordinal / 3.0) AS BIGINT) % 4 <> 0, -ordinal, 'gone' FROM {products} WHERE ordinal % 18 = 3) x""",
    "exclusions": """SELECT ordinal AS a, ordinal + 2 AS b FROM {products} WHERE ordinal % 11 = 0""",
    # members that machines set on their own, and pairs that they keep apart
    "alone_members": """
        SELECT ordinal AS member, CASE WHEN ordinal % 14 = 3 THEN 'old' ELSE name || '/' || CAST(image AS STRING) END AS version, 'm' || CAST(m AS STRING) AS machine
        FROM {products} JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 3) k ON ordinal % 7 = 3 AND (ordinal + m) % 3 > 0""",
    "machine_exclusions": """
        SELECT ordinal AS a, ordinal + m AS b, 'm' || CAST(1 + (ordinal + m) % 3 AS STRING) AS machine FROM {products} JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 5) k ON ordinal % 6 = m""",
    # offers' pages: pages with the data of three parts in one of the ways in which shops give it, or in none
    "offer_pages": """
        SELECT g.page_id, g.page_id % 5 AS way, a.p_partkey AS k1, a.p_name AS n1, a.p_size AS s1, b.p_partkey AS k2, b.p_name AS n2, b.p_size AS s2,
          '<a href="https://x.example/offer/' || CAST(a.p_partkey AS STRING) || '.html?a=1&amp;b=2">1</a><a href="/item/' || CAST(b.p_partkey AS STRING) || '.html">2</a><a href="/offer/' || CAST(a.p_partkey AS STRING) || '.html">3</a>' || g.html ||
          CASE WHEN g.page_id % 5 IN (0, 1) THEN '<script>d={"imageList":[{"fullPathImageURI":"https:\\/\\/i.example\\/' || CAST(a.p_partkey AS STRING) || '.jpg"}],"skuProps":[{"prop":"c","value":[{"name":"' || a.p_name || '","imageUrl":"//i/' || CAST(a.p_partkey AS STRING) || '.jpg"},{"name":"none"}]}],"skuInfoMap":{"a":{"specAttrs":"'
              || a.p_name || '&gt;big {x","skuId":' || CAST(a.p_partkey AS STRING) || ',"discountPrice":"' || CAST(a.p_size AS STRING) || '.5","canBookCount":' || CAST(a.p_size AS STRING) || '},"b":' || CASE WHEN g.page_id % 5 = 0 THEN '{"specAttrs":"' || b.p_name || '","price":"1,200.5","quantity":"' || CAST(b.p_size AS STRING) || '万"}' ELSE '"broken"' END || '}};</script>'
            WHEN g.page_id % 5 = 2 THEN '</p><div>' || a.p_name || ' ¥' || CAST(a.p_size AS STRING) || '.5 库存' || CAST(a.p_size AS STRING) || '个</div><div>' || a.p_name || ' ¥' || CAST(a.p_size AS STRING) || '.5 库存' || CAST(a.p_size AS STRING) || '个</div><p>' || b.p_name || '  ￥ 7 库存: 1,234</p>'
            WHEN g.page_id % 5 = 3 THEN '<script>d={"isSkuOffer":false,"skuInfoMap":[],"tradeModel":{"priceDisplay":"12.5","canBookedAmount":' || CAST(a.p_size AS STRING) || '}}</script><meta property="og:image" content="//i/' || CAST(a.p_partkey AS STRING) || '.png">'
            ELSE '' END AS html
        FROM {pages} g JOIN {part} a ON a.p_partkey = g.page_id JOIN {part} b ON b.p_partkey = g.page_id + 1""",
    # paths of packages as machines leave them; some lie in another's folder
    "package_paths": """
        SELECT DISTINCT 'raw-' || machine || '/data/' || CAST(ISOYEAR(date) AS STRING) || '/W' || lpad(CAST(weekofyear(date) AS STRING), 2, '0') || '-' || CASE WHEN day(date) = 9 THEN 'm9' ELSE machine END || '.db.gz' AS path FROM {machine_inventory}""",
    "object_lines": """
        SELECT CASE WHEN page_id % 3 = 0 THEN 'key: img/' || substring(md5(html), 1, 2) || '/' || md5(html) || '.png' WHEN page_id % 3 = 1 THEN 'img/' || substring(md5(html), 1, 2) || '/' || md5(html) || '.jpg | ' || CAST(length(html) AS STRING) || ' | STANDARD' ELSE '----' END AS line FROM {pages}""",
    "listed_sources": """SELECT week, shop, CASE WHEN week = 3 AND shop % 10 = 0 THEN 'm9' ELSE 'm' || CAST(shop % 3 + 1 AS STRING) END AS machine FROM {weekly_plan} WHERE shop % 40 <> week""",
    # merchant codes of products: some have none, some share one
    "coded": """SELECT ordinal, shop, name, CASE WHEN ordinal % 4 = 0 THEN NULL ELSE 'C-' || CAST(ordinal % 37 AS STRING) END AS code FROM {products}""",
    # pairs kept apart, many of one code, and members that are in no group
    "code_exclusions": """SELECT a, b FROM {exclusions} UNION SELECT ordinal, ordinal + 37 FROM {products} WHERE ordinal % 5 = 0 UNION SELECT ordinal + 74, ordinal FROM {products} WHERE ordinal % 9 = 1 UNION SELECT ordinal, ordinal + 111 FROM {products} WHERE ordinal % 7 = 2""",
    "excluded_members": """SELECT doc_id AS m FROM {labels} WHERE quality = 0 AND doc_id % 5 = 0""",
    # names with codes written one way and, later, another
    "renamed": """
        SELECT ordinal, CASE WHEN ordinal % 4 = 0 THEN name || ' #c-' || CAST(ordinal % 37 AS STRING) || '#' ELSE name END AS raw,
          CASE WHEN ordinal % 4 = 0 THEN name || ' # C-' || CAST(ordinal % 37 + CASE WHEN ordinal % 8 = 0 THEN 1 ELSE 0 END AS STRING) || '#' WHEN ordinal % 7 = 0 THEN name || ' new' ELSE name END AS renamed FROM (SELECT ordinal, replace(name, '#', '-') AS name FROM {products}) x""",
    # observed SKUs in two batches; some offers are seen as one, some attempts fail
    "observed": """
        SELECT l_orderkey % 2 AS batch, l_orderkey % 20 AS round_id, 'S' || CAST(l_suppkey % 3 AS STRING) AS shop, 'o' || CAST(l_partkey % 60 AS STRING) AS offer,
          CASE WHEN l_orderkey % 7 = 0 THEN 'default' ELSE CAST(CAST(l_quantity AS BIGINT) % 5 AS STRING) END AS sku, CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T20:00:00' AS seen_at, max(l_returnflag) = 'R' AS failed,
          min(l_linenumber) AS attempt, CAST(max(l_quantity) AS BIGINT) AS stock, max(l_extendedprice) AS price, max(CASE WHEN l_linestatus = 'O' THEN 'name ' || CAST(l_suppkey % 9 AS STRING) END) AS detail_title
        FROM {lineitem} GROUP BY ALL""",
    "statuses": """
        SELECT ordinal, CASE WHEN ordinal % 5 = 0 THEN 'failed' WHEN ordinal % 11 = 0 THEN 'needs_config' WHEN ordinal % 7 = 0 THEN 'missing' WHEN ordinal % 23 = 0 THEN 'disabled' ELSE 'judged' END AS state, 'reason ' || CAST((ordinal * 5) % 7 AS STRING) AS status FROM {products}""",
    "weekly_plan": """
        SELECT s_suppkey AS shop, CAST(s_suppkey % 25 AS BIGINT) AS pages, w AS week, 'm' || CAST((s_suppkey * 7 + w * (s_suppkey % 4)) % 3 + 1 AS STRING) AS machine
        FROM {supplier} CROSS JOIN (SELECT 1 AS w UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) weeks""",
}


def _inputs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in TABLES or n in VIEWS]


class Views:
    """The views as DataFrames of one folder of tables; each is planned lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.sql(VIEWS[name])

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        text = re.sub(r"EPOCHMS\(([^()]*)\)", r"(unix_micros(CAST(\1 AS TIMESTAMP)) DIV 1000)", text)
        text = re.sub(r"ISOYEAR\(([^()]*)\)", r"extract(yearofweek FROM \1)", text)
        text = re.sub(r"JOINED_SET\((\w+)\)", r"array_join(array_sort(collect_set(\1)), ',')", text)
        text = re.sub(r"HEX7\((substring\([^()]*\))\)", r"CAST(conv(\1, 16, 10) AS BIGINT)", text)
        # braces that name no input are text
        text = re.sub(r"\{(\w+)\}|[{}]", lambda m: m[0] if m[1] in TABLES or m[1] in VIEWS else "".join(2 * c if c in "{}" else c for c in m[0]), text)
        return self.spark.sql(text, **{n: more[n] if n in more else self[n] for n in _inputs(text)})


def duck(text: str) -> str:
    """The same query for DuckDB, with the views it needs as common table expressions."""
    need: list[str] = []

    def visit(t: str) -> None:
        for n in _inputs(t):
            if n not in TABLES and n not in need:
                visit(VIEWS[n])
                need.append(n)

    visit(text)
    text = re.sub(r"EPOCHMS\(([^()]*)\)", r"(epoch_us(\1) // 1000)", text)
    text = re.sub(r"JOINED_SET\((\w+)\)", r"array_to_string(list_sort(list_distinct(list(\1))), ',')", text)
    text = re.sub(r"HEX7\((substring\([^()]*\))\)", r"CAST('0x' || \1 AS BIGINT)", text)
    spell = lambda t: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in VIEWS else m[0], t)
    views = ", ".join(f"{n} AS ({spell(VIEWS[n])})" for n in need)
    body = spell(text).strip()
    if not views:
        return body
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {views}, {body[14:]}"
    return f"WITH {views}, {body[4:]}" if re.match(r"WITH\b", body, re.I) else f"WITH {views} {body}"
