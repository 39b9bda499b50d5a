"""Product price workflow: page snapshot to (title, price, date) rows, the
appended daily history (Structured Streaming), and daily price ranges.

Input: ``price_snapshots`` (page_id, url, seen_on, html); title and price are read from the page's elements.
The snapshot date is data (``seen_on``), not the wall clock, so reruns give
the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orchard.sources import views as V
from orchard.streaming.prices import daily_price_frame, daily_prices, extract_prices, price_history

COLS = ["page_id", "url", "seen_on", "title", "price"]


def q_page_extract(spark, d):
    return extract_prices(V.price_snapshots(spark, d)).select(*COLS)


def q_price_history(spark, d):
    return price_history(spark, V.price_snapshots(spark, d)).select(*COLS).orderBy("seen_on", "page_id")


def price_daily_batch(spark, d):
    """Batch twin of the daily-window stream."""
    p = extract_prices(V.price_snapshots(spark, d))
    return daily_price_frame(p).select("url", F.to_date(F.col("w.start")).alias("day"), "min_price", "max_price",
                                       "last_price", "n_snapshots")


def q_price_daily(spark, d):
    return daily_prices(spark, V.price_snapshots(spark, d))


QUERIES = {
    "page_extract": q_page_extract,
    "price_history": q_price_history,
    "price_daily": q_price_daily,
}

# the SQL twin knows the shape of these two elements; entities other than these do not occur in headings
_EXTRACT = r"""SELECT page_id, url, seen_on,
  trim(replace(replace(replace(replace(regexp_extract(html, '<h1 id="productTitle">(.*?)</h1>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title,
  TRY_CAST(nullif(replace(regexp_extract(regexp_extract(html, '<div id="apex_desktop">(.*?)</span></div>', 1, 's'),
    '([0-9][0-9,]*(\.[0-9]+)?)', 1), ',', ''), '') AS DOUBLE) AS price
  FROM price_snapshots"""

ORACLE = {
    "page_extract": V.with_views(_EXTRACT, "price_snapshots"),
    "price_history": V.with_views(
        f"SELECT * FROM (SELECT DISTINCT ON (url, seen_on) * FROM ({_EXTRACT}) e) d ORDER BY seen_on, page_id",
        "price_snapshots"),
    "price_daily": V.with_views(
        f"""SELECT url, seen_on AS day, min(price) AS min_price, max(price) AS max_price,
              arg_max(price, seen_on) AS last_price, count(*) AS n_snapshots FROM ({_EXTRACT}) e GROUP BY url, seen_on""",
        "price_snapshots"),
}
