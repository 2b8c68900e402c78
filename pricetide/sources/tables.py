"""Job inputs built from the stored tables, in SQL that Spark and other engines read alike.

``{name}`` stands for a table. ``load`` fills in Spark tables, ``text`` the plain names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_KEY = "CASE {0} % 5 WHEN 0 THEN 'walmart' WHEN 1 THEN 'ebay' WHEN 2 THEN 'amazon' WHEN 3 THEN 'bestbuy' ELSE 'target' END"

INPUTS = {
    "offers": """
SELECT l_suppkey * 10000000 + l_partkey AS offer_id, l_partkey AS product_id, l_suppkey AS source_id,
       floor(l_extendedprice / l_quantity * 100) / 100 AS price,
       CASE WHEN l_returnflag = 'A' THEN 'in_stock' WHEN l_returnflag = 'R' THEN 'out_of_stock' WHEN l_linestatus = 'O' THEN 'preorder' ELSE 'unknown' END AS availability,
       l_discount * 50 AS rating, CAST(l_quantity AS INT) AS review_count, l_shipdate AS last_seen_at, l_tax AS shipping_price
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM {lineitem}) AS newest
WHERE rn = 1""",
    "history": """
SELECT l_suppkey * 10000000 + l_partkey AS offer_id, l_orderkey * 10 + l_linenumber AS seq,
       floor(l_extendedprice / l_quantity * 100) / 100 AS price, l_returnflag AS availability, l_shipdate AS captured_at
FROM {lineitem}""",
    "products": """
SELECT p_partkey AS product_id, p_name || ' ' || p_type AS canonical_title, p_brand AS brand, 'M' || CAST(p_partkey AS STRING) AS mpn,
       CASE WHEN p_partkey % 3 = 0 THEN '00' || CAST(p_partkey AS STRING) END AS gtin,
       lower(p_brand) || '|' || lower(p_name) || '|' || CAST(p_partkey AS STRING) AS normalized_key
FROM {part}""",
    "searches": """
SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN substring(p_type, 1, 1 + CAST(p_size AS INT) % 4) WHEN 1 THEN upper(p_name) WHEN 2 THEN substring(p_name, 2, 5) || '_' || substring(p_type, 1, 3)
  WHEN 3 THEN substring(p_name, 1, 3) || '%' || substring(p_type, 2, 4) WHEN 4 THEN substring(p_type, 2, 5) || CAST(p_size AS STRING) ELSE substring(p_name || ' ' || p_type, 1 + CAST(p_size AS INT) % 9, 7) END AS query
FROM {part}""",
    "raw_products": """
SELECT p_partkey AS in_id,
       CASE p_partkey % 4 WHEN 0 THEN '  Sale ' WHEN 1 THEN 'Clearance  ' WHEN 2 THEN 'New Lower Price ' ELSE '' END || p_name || '   ' || p_type || CASE WHEN p_partkey % 5 = 0 THEN ' DEAL ' ELSE '' END AS title,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN upper(p_brand) || '  co' ELSE lower(p_brand) END AS brand,
       CASE WHEN p_partkey % 3 = 0 THEN 'M' || CAST(p_partkey AS STRING) END AS mpn, 'S' || CAST(p_size AS STRING) AS sku, CAST(NULL AS STRING) AS model_number
FROM {part}""",
    "incoming": """
SELECT p_partkey AS in_id, p_name || ' ' || p_type AS canonical_title,
       CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS brand,
       CASE WHEN p_partkey % 5 = 1 THEN 'M' || CAST(p_partkey AS STRING) END AS mpn, CAST(NULL AS STRING) AS model_number,
       CASE WHEN p_partkey % 6 = 0 THEN '00' || CAST(p_partkey AS STRING) END AS gtin,
       CASE WHEN p_partkey % 4 = 0 THEN lower(p_brand) || '|' || lower(p_name) || '|' || CAST(p_partkey AS STRING) WHEN p_partkey % 4 = 1 THEN 'new|' || p_name END AS normalized_key
FROM {part}""",
    "sources": f"""
SELECT s_suppkey AS source_id, s_name AS name, {_KEY.format("s_suppkey")} AS retailer_key,
       CASE s_suppkey % 7 WHEN 0 THEN 'paused' WHEN 1 THEN 'error' WHEN 2 THEN 'pending_review' ELSE 'active' END AS status,
       CASE s_suppkey % 4 WHEN 0 THEN 'managed_retailer_search' WHEN 1 THEN 'google_shopping' ELSE 'api' END AS source_type,
       s_suppkey % 7 > 2 AS allowed,
       CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE 'https://' || {_KEY.format("s_suppkey")} || '.example.com/s?q={{{{query}}}}' END AS search_url_template
FROM {{supplier}}""",
    "log": f"""
SELECT event_id AS seq, CASE user_id % 8 WHEN 0 THEN 'brightdata_scraping_browser' WHEN 1 THEN 'brightdata_unlocker' WHEN 2 THEN 'external_scrapfly' WHEN 3 THEN 'proxy_http' WHEN 4 THEN 'captcha_browser' WHEN 5 THEN 'browser_grid' WHEN 6 THEN 'js_browser' ELSE 'http_impersonate' END AS provider,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE {_KEY.format("user_id")} END AS retailer_key,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'blocked' WHEN 'purchase' THEN 'timeout' ELSE 'ok' END AS status,
       value * 100 AS latency_ms, ts AS created_at, user_id,
       CASE event_id % 6 WHEN 0 THEN 'captcha_detected' WHEN 1 THEN 'customer_suspended' WHEN 2 THEN 'browser_grid_timeout' WHEN 3 THEN 'socket closed' WHEN 4 THEN 'insufficient balance' ELSE NULL END AS error
FROM {{events}}""",
    "fetches": f"""
SELECT p.page_id AS fetch_id, p.page_id % 97 AS source_id, p.page_id, CASE WHEN p.page_id % 13 = 0 THEN p.url || '/blocked' ELSE p.url END AS url, p.html,
       CASE p.page_id % 10 WHEN 3 THEN 403 WHEN 7 THEN 429 ELSE 200 END AS http_status, CAST(p.page_id % 4 + 1 AS INT) AS tier,
       CASE WHEN p.page_id % 8 = 5 THEN 'error' WHEN p.page_id % 8 = 6 THEN 'blocked' ELSE 'ok' END AS status,
       CASE WHEN p.page_id % 6 = 5 THEN NULL ELSE {_KEY.format("p.page_id")} END AS retailer_key,
       CASE p.page_id % 3 WHEN 0 THEN 'browser_grid' WHEN 1 THEN 'brightdata_scraping_browser' ELSE 'curl' END AS fetch_backend,
       CASE p.page_id % 5 WHEN 0 THEN 'Robot Check' WHEN 1 THEN 'Access Denied' ELSE 'Shop' END AS title,
       CASE p.page_id % 9 WHEN 0 THEN 'Please verify you are human' WHEN 1 THEN 'Sign in to continue' WHEN 2 THEN 'rate limit reached' WHEN 3 THEN 'Something went wrong' WHEN 4 THEN 'security notice' ELSE 'Welcome to the shop' END || CASE WHEN p.page_id % 2 = 0 THEN repeat(' filler', 400) ELSE '' END AS text,
       CASE p.page_id % 7 WHEN 0 THEN 'captcha' WHEN 1 THEN 'datadome_block' WHEN 2 THEN 'login_wall' WHEN 3 THEN 'odd' ELSE NULL END AS block_reason,
       CASE p.page_id % 7 WHEN 0 THEN 'paused' WHEN 1 THEN 'error' WHEN 2 THEN 'pending_review' ELSE 'active' END AS source_status,
       CASE p.page_id % 4 WHEN 0 THEN 'managed_retailer_search' WHEN 1 THEN 'google_shopping' ELSE 'api' END AS source_type,
       p.page_id % 11 <> 0 AS robots_ok, p.page_id % 3 <> 0 AS escalate_on_block, timestamp '2024-01-30 00:00:00' AS created_at
FROM {{pages}} AS p""",
    "priced": f"""
SELECT g.page_id, g.url, {_KEY.format("g.page_id")} AS retailer_key, coalesce(p.p_name, 'page ' || CAST(g.page_id AS STRING)) AS query,
       g.html || coalesce('<script type="application/ld+json">{{{{"@type":"Product","name":"' || p.p_name || '","brand":{{{{"name":"' || p.p_brand || '"}}}},"sku":"S' || CAST(p.p_partkey AS STRING) || '","offers":{{{{"price":"' || CAST(p.p_size * 10 AS STRING) || '.50","availability":"https://schema.org/' || CASE WHEN p.p_size % 2 = 0 THEN 'InStock' ELSE 'OutOfStock' END || '"}}}},"aggregateRating":{{{{"ratingValue":"4.5","reviewCount":"' || CAST(p.p_size AS STRING) || '"}}}}}}}}</script>'
         || '<meta property="og:image" content="https://img.example.com/' || CAST(p.p_partkey AS STRING) || '.jpg">'
         || '<div data-automation-id="product-price">$' || CAST(p.p_size * 7 AS STRING) || '.99</div><span class="s-item__price">$1,' || lpad(CAST(p.p_size AS STRING), 3, '0') || '.25</span>'
         || '<span itemprop="price" content="' || CAST(p.p_size * 10 AS STRING) || '.50"></span><p class="amount">$ 1999</p><b aria-label="Now $' || CAST(p.p_size + 20 AS STRING) || '.5">x</b>'
         || '{{{{"currentPrice": ' || CAST(p.p_size * 9 AS STRING) || '.75, "customerPrice": 45.5}}}}'
         || '<a href="/news/' || CAST(p.p_partkey AS STRING) || '"><h3>Headline about ' || p.p_name || '</h3></a><a href="/news/two"><h3>Second   headline here</h3></a>', '') AS html,
       coalesce('Now $' || CAST(p.p_size * 7 AS STRING) || '.99 and current price $ 1,' || lpad(CAST(p.p_size AS STRING), 3, '0') || ' or $49.5 case $14.99', 'nothing here') AS page_text
FROM {{pages}} AS g LEFT JOIN {{part}} AS p ON p.p_partkey = g.page_id""",
    "listings": """
SELECT p_partkey % 200 AS payload_id, p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN 'xbox ' ELSE '' END || 'query' AS query,
       CASE p_partkey % 17 WHEN 0 THEN ':root{{}}' WHEN 1 THEN '' ELSE '  ' || p_name || ' ' END AS product_name,
       CASE p_partkey % 5 WHEN 0 THEN '$1,' || lpad(CAST(p_size AS STRING), 3, '0') || '.50' WHEN 1 THEN 'n/a' ELSE CAST(p_size * 6 AS STRING) || '.25' END AS price,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 8 AS STRING) END AS original_price, CASE WHEN p_partkey % 4 = 0 THEN upper(p_brand) ELSE p_brand END AS seller,
       'https://x.example.com/' || CAST(p_partkey AS STRING) AS product_url
FROM {part}""",
    "results": f"""
SELECT p_name AS query, {_KEY.format("p_partkey")} AS retailer_key, CASE p_partkey % 6 WHEN 4 THEN 'blocked' WHEN 5 THEN 'error' WHEN 3 THEN 'ok_via_google' ELSE 'ok' END AS status,
       CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 16 = 0 THEN 0.0 ELSE floor(p_retailprice * 100) / 100 END AS price,
       CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice * 110) / 100 END AS original_price, CASE WHEN p_partkey % 9 = 0 THEN 'product_not_found' END AS error, p_partkey AS result_id
FROM {{part}}""",
    "replies": """
SELECT p_partkey AS page_id, p_partkey % 300 AS payload_id, CAST(p_partkey % 3 AS INT) AS panel, p_name AS query,
       CASE WHEN p_partkey % 7 = 0 THEN '```json' || chr(10) ELSE '' END ||
       CASE WHEN p_partkey % 11 = 0 THEN '{{"product_name": "' || p_name || '", "price": ' || CAST(p_size * 12 AS STRING) || '.5, "seller": "' || p_brand
            WHEN p_partkey % 13 = 0 THEN 'no json here'
            WHEN p_partkey % 17 = 0 THEN 'Result: {{"price": 51.25, "title": "inner"}} done'
            ELSE '{{"product_name": "' || p_name || '", "price": ' || CAST(p_size * 12 AS STRING) || '.5, "quote_header": {{"regularMarketPrice": ' || CAST(p_size AS STRING) || '.25, "none": null}}, "news": [1], "_raw": 1, "products": [{{"product_name": "' || p_name || '", "price": "$' || CAST(p_size * 12 AS STRING) || '.5", "seller": "' || p_brand || '"}},{{"title": "other", "price": 77.5}},], }}' END ||
       CASE WHEN p_partkey % 7 = 0 THEN chr(10) || '```' ELSE '' END AS reply
FROM {part}""",
    "flat": """
SELECT p_brand AS ticker, k.name, CASE WHEN k.n = 1 THEN CAST(p_partkey % 50 AS STRING) || '.5' WHEN k.n = 3 AND p_partkey % 2 = 0 THEN '0' WHEN k.n = 5 THEN p_name ELSE CAST(p_size AS STRING) || '.25' END AS value, CAST(p_partkey * 10 + k.n AS BIGINT) AS prio
FROM {part} JOIN (SELECT 1 AS n, 'asp.regularMarketPrice' AS name UNION ALL SELECT 2, 'vision.regularMarketPrice' UNION ALL SELECT 3, 'summaryDetail.trailingPE' UNION ALL SELECT 4, 'asp.trailingPE' UNION ALL SELECT 5, 'asp.shortName' UNION ALL SELECT 6, 'vision.news.0' UNION ALL SELECT 7, 'html.regularMarketPrice') AS k ON (p_partkey + k.n) % 3 <> 0 AND (k.n <> 2 OR p_size > 25)""",
    "observed": """
SELECT l_suppkey AS source_id, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'Part ' || CAST(l_partkey % 400 AS STRING) END AS title, l_partkey AS product_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE floor(l_extendedprice / l_quantity * 100) / 100 END AS price, l_returnflag AS availability, l_discount * 50 AS rating,
       CAST(l_quantity AS INT) AS review_count, CASE WHEN l_linenumber % 2 = 0 THEN 'u' || CAST(l_orderkey AS STRING) END AS url, l_shipdate AS observed_at, l_orderkey * 10 + l_linenumber AS seq
FROM {lineitem}""",
    "stored": """
SELECT 'o' || CAST(l_suppkey AS STRING) || '-' || CAST(l_partkey % 400 AS STRING) AS offer_id, l_suppkey AS source_id, 'Part ' || CAST(l_partkey % 400 AS STRING) AS title, 'Shop ' || CAST(l_suppkey AS STRING) AS merchant_name, 'EUR' AS currency, min(l_partkey) AS product_id, max(floor(l_extendedprice / l_quantity * 100) / 100) AS price,
       min(l_returnflag) AS availability, max(l_discount * 50) AS rating, CAST(max(l_quantity) AS INT) AS review_count, 'old' AS url, min(l_shipdate) AS last_seen_at
FROM {lineitem} WHERE l_partkey % 3 = 0 GROUP BY l_suppkey, l_partkey % 400""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", sql)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input as a Spark table."""
    sql = INPUTS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def text(name: str) -> str:
    """The input as plain SQL over the table names."""
    sql = INPUTS[name]
    return sql.format(**{t: t for t in tables_of(sql)})


def with_inputs(sql: str, *names: str) -> str:
    """``sql`` with the named inputs as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({text(n)})" for n in names) + "\n" + sql.strip()
