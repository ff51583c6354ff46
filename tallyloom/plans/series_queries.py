"""Series queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import series
from tallyloom.plans.adapter import Views, duck

START, END = "2024-01-05", "2024-01-25"


def _chain(cap: bool) -> str:
    return f"""
WITH v AS (SELECT * FROM {{inventory}} WHERE stock IS NOT NULL),
f AS (SELECT * FROM v WHERE (shop, offer) IN (SELECT (shop, offer) FROM v WHERE date BETWEEN DATE '{START}' AND DATE '{END}'){f" AND date <= DATE '{END}'" if cap else ""}),
dd AS (SELECT shop, offer, date, bool_or(sku = 'default') AS is_default FROM f GROUP BY ALL),
fl AS (SELECT *, coalesce(CAST(lag(is_default) OVER (PARTITION BY shop, offer ORDER BY date) <> is_default AS INT), 0) AS flip FROM dd),
sg AS (SELECT *, sum(flip) OVER (PARTITION BY shop, offer ORDER BY date) AS segment FROM fl),
g0 AS (SELECT shop, offer, segment, min(date) AS begins, bool_or(is_default) AS is_default FROM sg GROUP BY ALL),
g AS (SELECT *, lead(begins) OVER w AS until,
  CASE WHEN row_number() OVER w = 1 THEN DATE '{START}' ELSE greatest(DATE '{START}', begins) END AS low,
  least(DATE '{END}', coalesce(CAST(lead(begins) OVER w - INTERVAL 1 DAY AS DATE), DATE '{END}')) AS high FROM g0 WINDOW w AS (PARTITION BY shop, offer ORDER BY segment)),
own AS (SELECT f.shop, f.offer, f.sku, f.date, f.stock, g.segment, begins, low, high FROM f JOIN g ON f.shop = g.shop AND f.offer = g.offer AND f.date >= begins AND (until IS NULL OR f.date < until)),
facts AS (SELECT shop, offer, segment, sku, begins, low, high, min(date) AS first, arg_max(stock, date) FILTER (date < low) AS prior, arg_min(stock, date) FILTER (date > low) AS next FROM own WHERE low <= high GROUP BY ALL),
spine AS (SELECT *, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS date FROM facts),
j AS (SELECT spine.*, own.stock AS actual FROM spine LEFT JOIN own USING (shop, offer, segment, sku, date)),
c AS (SELECT *, coalesce(last_value(actual IGNORE NULLS) OVER (PARTITION BY shop, offer, segment, sku ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), prior, next) AS s FROM j),
l AS (SELECT *, lag(s) OVER (PARTITION BY shop, offer, segment, sku ORDER BY date) AS p FROM c),
series AS (SELECT shop, offer, CAST(segment AS BIGINT) AS segment, sku, date, CAST(s AS BIGINT) AS stock,
  CAST(CASE WHEN p IS NULL OR date = DATE '{START}' THEN 0 ELSE greatest(p - s, 0) END AS BIGINT) AS sales,
  CASE WHEN actual IS NULL THEN 'yellow' WHEN p < s THEN 'red' ELSE 'green' END AS color
  FROM l WHERE first <= begins OR date >= greatest(low, first))"""


def _series(v: Views, cap: bool = False) -> DataFrame:
    return series.sku_series(v["inventory"], START, END, cap)


def ranking(v: Views) -> DataFrame:
    """The flagship: offers ranked by inferred sales in the range."""
    offers = _series(v).groupBy("shop", "offer").agg(F.sum("sales").cast("long").alias("sales"))
    return series.rank(offers, F.desc("sales"), "shop", "offer")


QUERIES = {
    "sales_series": _series,
    "sku_sales_series_capped": lambda v: _series(v, True),
    "product_series": lambda v: series.roll_up(_series(v), "shop", "offer"),
    "shop_series": lambda v: series.roll_up(_series(v), "shop"),
    "sales_totals": lambda v: series.totals(_series(v)),
    "segments": lambda v: series.segments(series.freeze(v["inventory"], START, END), START, END).select("shop", "offer", F.col("segment").cast("long").alias("segment"), "is_default", "begins", "low", "high"),
    "shape_switches": lambda v: series.switches(series.segments(series.freeze(v["inventory"], START, END), START, END)),
    "ranking": ranking,
}

_ROLL = "CAST(sum(stock) AS BIGINT) AS stock, CAST(sum(sales) AS BIGINT) AS sales, CASE WHEN bool_or(color = 'red') THEN 'red' ELSE 'green' END AS color"
SQL = {
    "sales_series": duck(_chain(False) + " SELECT * FROM series"),
    "sku_sales_series_capped": duck(_chain(True) + " SELECT * FROM series"),
    "product_series": duck(_chain(False) + f" SELECT shop, offer, date, {_ROLL} FROM series GROUP BY shop, offer, date"),
    "shop_series": duck(_chain(False) + f" SELECT shop, date, {_ROLL} FROM series GROUP BY shop, date"),
    "sales_totals": duck(_chain(False) + " SELECT CASE grouping(shop, offer, sku) WHEN 0 THEN 'sku' WHEN 1 THEN 'offer' WHEN 3 THEN 'shop' ELSE 'all' END AS level, shop, offer, sku, CAST(sum(sales) AS BIGINT) AS sales FROM series GROUP BY ROLLUP (shop, offer, sku)"),
    "segments": duck(_chain(False) + " SELECT shop, offer, CAST(segment AS BIGINT) AS segment, is_default, begins, low, high FROM g"),
    "shape_switches": duck(_chain(False) + " SELECT shop, offer, low AS date, is_default FROM (SELECT *, row_number() OVER (PARTITION BY shop, offer ORDER BY segment) AS n FROM g WHERE low <= high) WHERE n > 1"),
    "ranking": duck(_chain(False) + " SELECT shop, offer, sales, row_number() OVER (ORDER BY sales DESC, shop, offer) AS rank FROM (SELECT shop, offer, CAST(sum(sales) AS BIGINT) AS sales FROM series GROUP BY shop, offer)"),
}
