"""What offers' pages say: links, titles, SKUs by whatever way the page gives them, pictures. The SQL derives the
expected rows from the parts that the pages were made of, without reading a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.plans.adapter import duck

QUERIES = {
    "offer_links": lambda v: v["offer_pages"].select("page_id", F.posexplode(text.offer_links(F.col("html"))).alias("nth", "l")).select("page_id", "nth", "l.offer", "l.url"),
    "page_skus": lambda v: v["offer_pages"].select("page_id", F.inline(text.skus(F.col("html")))),
    "page_outcomes": lambda v: v["offer_pages"].select("page_id", text.outcome(text.skus(F.col("html"))).alias("outcome")),
    "main_pictures": lambda v: v["offer_pages"].select("page_id", text.main_picture(F.col("html")).alias("picture")),
    "visible_lines": lambda v: v["pages"].select("page_id", F.size(F.split(text.strip_tags(F.col("html")), "\n")).cast("long").alias("n_lines"), F.length(F.regexp_replace(text.strip_tags(F.col("html")), r"\s", "")).cast("long").alias("n_chars")),
}
_STRIPPED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), '</(div|p|li|tr|span|h\\d)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '[ \\t]*\\n[ \\t]*', chr(10), 'g'), '\\n{2,}', chr(10), 'g')"""
SQL = {
    "offer_links": duck("""SELECT page_id, 0 AS nth, CAST(k1 AS VARCHAR) AS offer, 'https://x.example/offer/' || k1 || '.html?a=1&b=2' AS url FROM {offer_pages} UNION ALL SELECT page_id, 1, CAST(k2 AS VARCHAR), '/item/' || k2 || '.html' FROM {offer_pages}"""),
    "page_skus": duck("""
      SELECT page_id, CAST(k1 AS VARCHAR) AS sku_id, 'platform' AS id_source, n1 || '&gt;big {x' AS name, s1 + 0.5::DOUBLE AS price, CAST(s1 AS BIGINT) AS stock, '//i/' || k1 || '.jpg' AS picture, way = 0 AS complete FROM {offer_pages} WHERE way IN (0, 1)
      UNION ALL SELECT page_id, substr(sha1(n2), 1, 16), 'derived', n2, 1200.5, s2::BIGINT * 10000, CASE WHEN n1 = n2 THEN '//i/' || k1 || '.jpg' END, true FROM {offer_pages} WHERE way = 0
      UNION ALL SELECT page_id, substr(sha1(n1), 1, 16), 'derived', n1, s1 + 0.5, s1, NULL, false FROM {offer_pages} WHERE way = 2
      UNION ALL SELECT page_id, substr(sha1(n2), 1, 16), 'derived', n2, 7, 1234, NULL, false FROM {offer_pages} WHERE way = 2
      UNION ALL SELECT page_id, 'default', 'platform', '默认(单规格)', 12.5, s1, NULL, true FROM {offer_pages} WHERE way = 3""".replace("{x'", "{{x'")).replace("{{x'", "{x'"),
    "page_outcomes": duck("SELECT page_id, ['complete', 'partial', 'text', 'single_spec', 'none'][1 + way] AS outcome FROM {offer_pages}"),
    "main_pictures": duck("SELECT page_id, CASE WHEN way < 2 THEN 'https://i.example/' || k1 || '.jpg' WHEN way = 3 THEN '//i/' || k1 || '.png' END AS picture FROM {offer_pages}"),
    "visible_lines": f"""WITH s AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace({_STRIPPED}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM pages)
      SELECT page_id, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[ \\t\\n\\r\\f\\x0b]', '', 'g')) AS BIGINT) AS n_chars FROM s""",
}
