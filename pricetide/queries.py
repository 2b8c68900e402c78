"""Registered queries: each applies an operator to its whole input table; with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pricetide.functions import prices, text
from pricetide.operators import catalog, compliance, finance, listings, metrics, pages, ranking, replies
from pricetide.operators.title_index import build_title_index
from pricetide.plans import crawl, shopping, stores
from pricetide.sources import envelopes
from pricetide.sources.tables import load, with_inputs
from pricetide.sources.work import materialize, new_path

AS_OF, LOG_AS_OF = "2001-12-01 00:00:00", "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str):
    """Register a job under its function's name."""

    def add(job):
        QUERIES[job.__name__] = job
        if sql:
            ORACLES[job.__name__] = with_inputs(sql, *inputs) if inputs else sql.strip()
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ranking

SCORE = """least(1.0, greatest(0.0, 0.0 + 0.30 * least(1.0, greatest(0.0, CASE WHEN price IS NULL OR lo IS NULL THEN 0.7 WHEN hi > lo THEN 1.0 - (price - lo) / (hi - lo) ELSE 1.0 END))
 + 0.20 * CASE lower(availability) WHEN 'in_stock' THEN 1.0 WHEN 'preorder' THEN 0.6 WHEN 'unknown' THEN 0.4 WHEN 'out_of_stock' THEN 0.0 ELSE 0.4 END
 + 0.20 * 0.7
 + 0.15 * CASE WHEN rating IS NULL THEN 0.5 ELSE least(1.0, greatest(0.0, rating / 5.0 * least(1.0, coalesce(review_count, 0) / 50.0))) END
 + 0.10 * CASE WHEN hours <= 24 THEN 1.0 WHEN hours <= 168 THEN 0.7 WHEN hours <= 720 THEN 0.4 ELSE 0.1 END
 + 0.05 * CASE WHEN shipping_price = 0 THEN 1.0 ELSE 0.5 END))"""
HOURS = f"(epoch(timestamp '{AS_OF}') - epoch(last_seen_at)) / 3600.0"


@query(
    f"""SELECT product_id, offer_id, rank, round(shopping_score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY shopping_score DESC, offer_id) AS rank FROM (
    SELECT *, {SCORE} AS shopping_score FROM (SELECT *, min(price) OVER (PARTITION BY product_id) AS lo, max(price) OVER (PARTITION BY product_id) AS hi, {HOURS} AS hours FROM offers) AS a) AS b) AS c
WHERE rank <= 5""",
    "offers",
)
def top_offers(spark, sf_dir):
    scored = ranking.score_offers(load(spark, sf_dir, "offers"), ["product_id"], AS_OF, small_groups=True)
    return ranking.rank_offers(scored, ["product_id"], 5).select("product_id", "offer_id", F.col("rank").cast("long").alias("rank"), F.round("shopping_score", 6).alias("score"))


@query(
    f"""SELECT query, offer_id, rank, round(shopping_score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY shopping_score DESC, offer_id) AS rank FROM (
    SELECT *, {SCORE} AS shopping_score FROM (
      SELECT *, min(price) OVER (PARTITION BY query) AS lo, max(price) OVER (PARTITION BY query) AS hi FROM (
        SELECT q.query, o.offer_id, o.price, o.availability, nullif(o.rating, 0) AS rating, o.review_count, CAST(NULL AS DOUBLE) AS shipping_price, {HOURS} AS hours
        FROM offers AS o JOIN products AS p ON p.product_id = o.product_id JOIN (SELECT unnest(['small', 'Red_W', 'gadget']) AS query) AS q ON p.canonical_title ILIKE '%' || lower(q.query) || '%'
        WHERE o.price IS NULL OR o.price <= 2000) AS a) AS b) AS c) AS d""",
    "offers", "products",
)
def ranked_search(spark, sf_dir):
    asked = spark.createDataFrame([("small",), ("Red_W",), ("gadget",)], "query string")
    out = ranking.ranked_search(load(spark, sf_dir, "offers"), load(spark, sf_dir, "products"), asked, AS_OF, 2000.0)
    return out.select("query", "offer_id", F.col("rank").cast("long").alias("rank"), F.round("shopping_score", 6).alias("score"))


@query(
    f"""SELECT offer_id, CAST(printf('%.4f', {SCORE}) AS DOUBLE) AS shopping_score FROM (
  SELECT offer_id, nullif(price, 0) AS price, availability, nullif(rating, 0) AS rating, review_count, nullif(shipping_price, 0) AS shipping_price, min(price) OVER () AS lo, max(price) OVER () AS hi, {HOURS} AS hours FROM offers) AS a""",
    "offers",
)
def recompute_scores(spark, sf_dir):
    return ranking.recompute_scores(load(spark, sf_dir, "offers"), AS_OF)


# ---- prices and pages

PLAUSIBLE = "x BETWEEN 25.0 AND 45000.0 AND NOT (x = floor(x) AND x BETWEEN 1990 AND 2035)"
TIDY = f"list_slice(list_sort(list_distinct(list_transform(list_filter(list_transform({{0}}, lambda r: try_cast(replace(r, ',', '') AS DOUBLE)), lambda x: {PLAUSIBLE}), lambda x: CAST(printf('%.2f', x) AS DOUBLE)))), 1, 20)"
STRIPPED = "regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g')"


def _all(column: str, pattern: str) -> str:
    return "regexp_extract_all({0}, '{1}', 1)".format(column, pattern.replace("'", "''"))


def _concat(column: str, patterns) -> str:
    return " || ".join(_all(column, p if p.startswith("(?i)") else f"(?i){p}") for p in patterns)


_HTML_ALL = _concat("blob", prices.HTML_PRICES) + " || CASE retailer_key " + " ".join(f"WHEN '{k}' THEN {_concat('blob', ps)}" for k, ps in prices.RETAILER_PRICES.items()) + " ELSE CAST([] AS VARCHAR[]) END"


@query(
    f"SELECT page_id, array_to_string(list_transform({TIDY.format(_HTML_ALL)}, lambda v: CAST(v AS VARCHAR)), ',') AS candidates FROM (SELECT *, left({STRIPPED.format('html')}, 500000) AS blob FROM priced) AS a",
    "priced",
)
def html_price_candidates(spark, sf_dir):
    found = prices.html_price_candidates(F.col("html"), F.col("retailer_key"))
    return load(spark, sf_dir, "priced").select("page_id", F.array_join(found.cast("array<string>"), ",").alias("candidates"))


@query(
    f"SELECT page_id, array_to_string(list_transform({TIDY.format(_all('page_text', prices.TEXT_PRICE))}, lambda v: CAST(v AS VARCHAR)), ',') AS candidates FROM priced",
    "priced",
)
def text_price_candidates(spark, sf_dir):
    return load(spark, sf_dir, "priced").select("page_id", F.array_join(prices.text_price_candidates(F.col("page_text")).cast("array<string>"), ",").alias("candidates"))


@query(
    f"""SELECT page_id, floor_usd, CASE WHEN len(cand) = 0 THEN NULL WHEN len(pool) = 1 THEN pool[1]
  ELSE CASE WHEN retailer_key IN ('walmart', 'ebay', 'amazon', 'target', 'bestbuy') THEN list_min(last) ELSE last[len(last) // 2 + 1] END END AS best
FROM (SELECT *, CASE WHEN len(high) >= 2 AND list_max(high) / greatest(list_min(high), 1.0) >= 3.0 AND len(cluster) > 0 THEN cluster ELSE high END AS last
FROM (SELECT *, list_filter(high, lambda p: p >= list_sort(high)[len(high) // 2 + 1] * 0.75) AS cluster
FROM (SELECT *, CASE WHEN len(list_filter(pool, lambda p: p >= greatest(floor_usd, 80.0))) > 0 THEN list_filter(pool, lambda p: p >= greatest(floor_usd, 80.0)) ELSE pool END AS high
FROM (SELECT *, CASE WHEN len(list_filter(cand, lambda p: p >= floor_usd)) > 0 THEN list_filter(cand, lambda p: p >= floor_usd) ELSE cand END AS pool
FROM (SELECT page_id, retailer_key, CASE WHEN regexp_matches(lower(query), 'osmo|pocket\\s*[34]|action\\s*cam') THEN 280.0 WHEN regexp_matches(lower(query), '\\b(iphone|macbook|ipad\\s*pro|playstation|xbox|gpu|rtx|drone|gimbal)\\b') THEN 120.0 ELSE 25.0 END AS floor_usd,
  list_slice(list_sort(list_distinct({TIDY.format(_HTML_ALL)} || {TIDY.format(_all('page_text', prices.TEXT_PRICE))})), 1, 20) AS cand
FROM (SELECT *, left({STRIPPED.format('html')}, 500000) AS blob FROM priced) AS a) AS b) AS c) AS d) AS e) AS f""",
    "priced",
)
def best_prices(spark, sf_dir):
    rows = load(spark, sf_dir, "priced")
    found = prices.merge_candidates(prices.html_price_candidates(F.col("html"), F.col("retailer_key")), prices.text_price_candidates(F.col("page_text")))
    rows = rows.withColumn("cand", found)
    return rows.select("page_id", prices.query_price_floor(F.col("query")).alias("floor_usd"), prices.best_price(F.col("cand"), F.col("query"), F.col("retailer_key")).alias("best"))


FOLDED = "left(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')), {1})"


@query(
    f"""SELECT page_id, title, status, char_count, md5(plain) AS plain_md5, md5(filing) AS filing_md5 FROM (
SELECT page_id, trim(regexp_extract(html, '(?i)<title[^>]*>([^<]{{1,500}})</title>', 1)) AS title, 'ok' AS status, length({FOLDED.format('html', 350000)}) AS char_count,
  left(regexp_replace(html, '<[^>]+>', ' ', 'g'), 200000) AS plain, {FOLDED.format('html', 12000)} AS filing FROM pages) AS a"""
)
def envelope_pages(spark, sf_dir):
    rows = envelopes.to_envelope(table(spark, sf_dir, "pages"), "folded")
    return rows.select("page_id", "title", "status", "char_count", F.md5(text.html_to_text(F.col("html")).cast("binary")).alias("plain_md5"), F.md5(text.html_to_text(F.col("html"), "filing").cast("binary")).alias("filing_md5"))


@query("SELECT url, 200 AS http_status, sha256(html) AS content_hash, length(left(html, 500000)) AS kept, length(html) AS content_chars FROM pages")
def snapshots(spark, sf_dir):
    made = envelopes.build_snapshots(envelopes.to_envelope(table(spark, sf_dir, "pages"), whole=True))
    return made.select("url", "http_status", "content_hash", F.length("content").alias("kept"), "content_chars")


@query(f"SELECT page_id, md5({STRIPPED.format('html')}) AS bare FROM pages")
def strip_noise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_noise(F.col("html")).cast("binary")).alias("bare"))


@query(
    """SELECT fetch_id, status <> 'error' AS success, CASE WHEN status <> 'error' THEN CAST(length(text) AS VARCHAR) END AS markdown_chars, CASE WHEN status <> 'error' THEN title END AS title, CASE WHEN status <> 'error' THEN CAST(http_status AS VARCHAR) END AS status_code,
  length(left(text, 2000)) AS excerpt_chars, CASE WHEN status = 'ok' THEN CAST(length(left(html, 5000)) AS VARCHAR) END AS html_chars FROM fetches""",
    "fetches",
)
def responses(spark, sf_dir):
    rows = load(spark, sf_dir, "fetches").withColumn("url", F.col("fetch_id").cast("string"))
    a = envelopes.to_scrape_response(rows).select(F.col("url").alias("u"), "success", F.length("markdown").cast("string").alias("markdown_chars"), "metadata.title", F.col("metadata.statusCode").cast("string").alias("status_code"))
    b = envelopes.to_crawl_payload(rows, 5000).select("url", F.length("excerpt").alias("excerpt_chars"), F.length("html").cast("string").alias("html_chars"))
    return a.join(b, a["u"] == b["url"]).select(F.col("u").cast("long").alias("fetch_id"), "success", "markdown_chars", "title", "status_code", "excerpt_chars", "html_chars")


@query(
    """SELECT doc_id, md5(left(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n\\n+', chr(10)), 120000)) AS clean FROM documents"""
)
def clean_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"), 120_000).cast("binary")).alias("clean"))


_TRIMMED = "regexp_replace({0}, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')"
_SHUT = f"s.shut || CASE WHEN {_TRIMMED.format('s.held')} = '' THEN [] ELSE [{_TRIMMED.format('s.held')}] END"
#: Chunks of ``documents`` as doc_id, chunk_no, chunk: blocks are folded into closed chunks and the one that is held open.
CHUNKED = f"""SELECT doc_id, CAST(no - 1 AS INT) AS chunk_no, chunk FROM (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) AS no FROM (
  SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 12000 THEN [coalesce(text, '')] ELSE {_SHUT} END AS cs FROM (
    SELECT doc_id, text, list_reduce(list_prepend({{'shut': CAST([] AS VARCHAR[]), 'held': ''}}, list_transform(string_split_regex(coalesce(text, ''), '\\n{{2,}}'), lambda b: {{'shut': CAST([] AS VARCHAR[]), 'held': b}})), lambda s, e:
      CASE WHEN length(e.held) > 12000 THEN {{'shut': {_SHUT} || list_transform(generate_series(1, length(e.held), 11200), lambda i: substring(e.held, i, 12000)), 'held': CASE WHEN {_TRIMMED.format('s.held')} = '' THEN s.held ELSE '' END}}
        WHEN s.held = '' THEN {{'shut': s.shut, 'held': e.held}}
        WHEN length(s.held) + length(e.held) + 2 <= 12000 THEN {{'shut': s.shut, 'held': s.held || chr(10) || chr(10) || e.held}}
        ELSE {{'shut': {_SHUT}, 'held': right(s.held, 800) || chr(10) || chr(10) || e.held}} END) AS s FROM documents) AS a) AS b) AS c"""


@query(f"SELECT doc_id, chunk_no, md5(chunk) AS chunk_md5, length(chunk) AS chars FROM ({CHUNKED}) AS d")
def document_chunks(spark, sf_dir):
    return pages.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), F.length("chunk").alias("chars"))


@query(
    """SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_filter(w, lambda x: x IN ('price', 'of', 'the', 'la', 'und'))) / sqrt(len(w)), 6) END AS score
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+') AS w FROM documents) AS a"""
)
def document_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.score_words(F.col("text"), F.lit("Price of the la und")), 6).alias("score"))


@query(
    f"""SELECT doc_id, chunk_no, length(chunk) AS chars, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_no) AS r FROM (
  SELECT *, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: x IN ('price', 'of', 'the', 'la', 'und'))) / sqrt(len(w)) END AS score
  FROM (SELECT *, regexp_extract_all(lower(chunk), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS w FROM ({CHUNKED}) AS d) AS e) AS f) AS g WHERE r <= 4"""
)
def best_chunks(spark, sf_dir):
    scored = pages.score_chunks(pages.chunk_documents(table(spark, sf_dir, "documents")), F.lit("price of the la und"))
    return pages.top_chunks(scored).select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.round("score", 6).alias("score"))


_CANDIDATES = f"list_slice(list_sort(list_distinct({TIDY.format(_HTML_ALL)} || {TIDY.format(_all('page_text', prices.TEXT_PRICE))})), 1, 20)"


@query(
    f"""SELECT page_id, retailer_key, array_to_string(list_transform(cand, lambda v: CAST(v AS VARCHAR)), ',') AS candidates,
  md5(left(CASE WHEN len(cand) > 0 THEN 'Pre-detected USD price candidates on this page: ' || array_to_string(list_transform(list_slice(cand, 1, 8), lambda p: printf('$%.2f', p)), ', ') || chr(10) || 'Use one of these for the main product if it matches ' || chr(39) || query || chr(39) || '.' || chr(10) || chr(10) ELSE '' END || page_text, 52000)) AS context
FROM (SELECT *, {_CANDIDATES} AS cand FROM (SELECT *, left({STRIPPED.format('html')}, 500000) AS blob FROM priced) AS a) AS b""",
    "priced",
)
def llm_contexts(spark, sf_dir):
    out = pages.build_llm_context(load(spark, sf_dir, "priced"))
    return out.select("page_id", "retailer_key", F.array_join(F.col("candidates").cast("array<string>"), ",").alias("candidates"), F.md5(F.col("context").cast("binary")).alias("context"))


_EXCERPT_WORDS = "|".join(text.EXCERPT_WORDS)
_ROUND_WORDS = " || ".join(f"CASE WHEN contains(lower(plain), '{w}') THEN regexp_extract_all(plain, '(?i).{{0,80}}{w}.{{0,200}}') ELSE CAST([] AS VARCHAR[]) END" for w in text.EXCERPT_WORDS)


@query(
    f"""SELECT page_id, left(CASE WHEN said = '' THEN page_text ELSE said END, 24000) AS excerpt FROM (
  SELECT page_id, page_text, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), chr(10)) AS said FROM (
    SELECT page_id, page_text, list_transform(CASE WHEN len(named) > 0 THEN named ELSE {_ROUND_WORDS} END, lambda x: {_TRIMMED.format('x')}) AS found FROM (
      SELECT *, list_filter(regexp_extract_all(plain, '.{{0,120}}\\$\\d[\\d,]*(?:\\.\\d{{2}})?.{{0,120}}'), lambda x: regexp_matches(lower(x), '{_EXCERPT_WORDS}')) AS named FROM (
        SELECT page_id, page_text, regexp_replace(regexp_replace(page_text || chr(10) || html, '<[^>]+>', ' ', 'g'), '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g') AS plain FROM priced) AS a) AS b) AS c) AS d""",
    "priced",
)
def price_excerpts(spark, sf_dir):
    return load(spark, sf_dir, "priced").select("page_id", text.price_excerpt(F.col("page_text"), F.col("html")).alias("excerpt"))


_STYLED = "CASE page_id % 3 WHEN 0 THEN ':root (a: b)' || chr(10) WHEN 1 THEN '  @charset x' || chr(10) ELSE '' END || regexp_replace(html, '<[^>]+>', chr(10){0})"


@query(
    f"""SELECT page_id, md5(CASE WHEN regexp_matches(t, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}]*(?::root|@charset|\\{{)') THEN left(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda s: {_TRIMMED.format('s')}),
    lambda s: length(s) > 3 AND NOT regexp_matches(s, '^(?:[:@{{}}]|--)') AND NOT regexp_matches(s, '^[\\s\\x1c-\\x1f\\x85\\p{{Z}}{{}};:@#.\\-0-9%]+$')), chr(10)), 350000) ELSE t END) AS clean FROM (SELECT page_id, {_STYLED.format(", 'g'")} AS t FROM pages) AS a"""
)
def sanitized_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.sanitize_text(F.expr(_STYLED.format(""))).cast("binary")).alias("clean"))


@query("SELECT page_id, md5(url) AS fetch_key, 'extract:' || md5(url || '||' || 'get prices') AS extract_key FROM pages")
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.fetch_key(F.col("url")).alias("fetch_key"), text.extract_key(F.col("url"), F.lit("  Get Prices ")).alias("extract_key"))


_FETCH_URL = "CASE user_id % 5 WHEN 0 THEN 'https://www.sec.gov/' WHEN 1 THEN 'https://finance.yahoo.com/quote/' WHEN 2 THEN 'https://seekingalpha.com/' ELSE 'https://x.example.com/' END || CAST(user_id AS STRING)"


@query(
    f"""SELECT url, seq FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, seq DESC) AS r FROM (
  SELECT {_FETCH_URL} AS url, seq, created_at, epoch(timestamp '2024-01-30 12:00:00') - epoch(date_trunc('second', created_at)) AS age FROM log) AS a
  WHERE age >= 0 AND age < CASE WHEN contains(url, 'sec.gov') THEN 86400 WHEN contains(url, 'finance.yahoo') THEN 300 WHEN contains(url, 'seekingalpha') THEN 1800 ELSE 600 END) AS b WHERE r = 1""",
    "log",
)
def fresh_fetches(spark, sf_dir):
    rows = load(spark, sf_dir, "log").select(F.expr(_FETCH_URL).alias("url"), "seq", F.col("created_at").alias("fetched_at"))
    return pages.fresh_fetches(rows, "2024-01-30 12:00:00").select("url", "seq")


# ---- listings

_LISTED = """SELECT * FROM (SELECT payload_id, pos, query, trim(product_name) AS product_name,
  CASE WHEN v BETWEEN 25.0 AND 45000.0 AND NOT (v = floor(v) AND v BETWEEN 1990 AND 2035) THEN CAST(printf('%.2f', v) AS DOUBLE) END AS price, CASE WHEN o BETWEEN 25.0 AND 45000.0 AND NOT (o = floor(o) AND o BETWEEN 1990 AND 2035) THEN CAST(printf('%.2f', o) AS DOUBLE) END AS before, seller, product_url
  FROM (SELECT *, try_cast(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS v, try_cast(original_price AS DOUBLE) AS o FROM listings) AS a) AS b
  WHERE product_name <> '' AND NOT regexp_matches(product_name, '^(?::root|@charset|\\{|--)|border-width') AND price >= CASE WHEN contains(lower(query), 'xbox') THEN 120.0 ELSE 25.0 END"""


@query(
    f"""SELECT payload_id, pos, product_name, price, CASE WHEN before > price THEN before END AS original_price, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY price, pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY payload_id, left(lower(product_name), 80), price, lower(seller) ORDER BY pos) AS r FROM ({_LISTED}) AS c) AS d WHERE r = 1) AS e WHERE rank <= 10""",
    "listings",
)
def top_listings(spark, sf_dir):
    out = listings.dedupe_listings(listings.normalize_listings(load(spark, sf_dir, "listings")))
    return out.select("payload_id", "pos", "product_name", "price", "original_price", F.col("rank").cast("long").alias("rank"))


@query(
    f"""SELECT payload_id, min_by(product_name, rank) AS product_name, min(price) AS price, min_by(seller, rank) AS seller, count(*) AS n_products FROM (
  SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY price, pos) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY payload_id, left(lower(product_name), 80), price, lower(seller) ORDER BY pos) AS r FROM ({_LISTED}) AS c) AS d WHERE r = 1) AS e WHERE rank <= 10 GROUP BY payload_id""",
    "listings",
)
def listing_rollup(spark, sf_dir):
    out = listings.rollup_listings(listings.dedupe_listings(listings.normalize_listings(load(spark, sf_dir, "listings"))))
    return out.select("payload_id", "product_name", "price", "seller", "n_products")


@query(
    """SELECT page_id, query AS title, 'Brand#' || regexp_extract(html, '"name":"Brand#([0-9]+)"', 1) AS brand, try_cast(regexp_extract(html, '"offers":\\{"price":"([0-9.]+)"', 1) AS DOUBLE) AS price,
  CASE WHEN contains(html, 'schema.org/InStock') THEN 'in_stock' ELSE 'out_of_stock' END AS availability, regexp_extract(html, '"sku":"(S[0-9]+)"', 1) AS sku, regexp_extract(html, 'og:image" content="([^"]+)"', 1) AS image_url, 4.5 AS rating, try_cast(regexp_extract(html, '"reviewCount":"([0-9]+)"', 1) AS INT) AS review_count FROM priced""",
    "priced",
)
def product_fields(spark, sf_dir):
    return listings.product_fields(load(spark, sf_dir, "priced")).select("page_id", "title", "brand", "price", "availability", "sku", "image_url", "rating", "review_count")


@query(
    """SELECT result_id, CASE WHEN error IS NULL AND price % 3 < 1 THEN price WHEN price >= 25 THEN CAST(printf('%.2f', price) AS DOUBLE) WHEN original_price >= 25 THEN original_price END AS price,
  CASE WHEN error IS NULL AND price % 3 < 1 THEN 'llm' WHEN price >= 25 THEN 'llm' WHEN original_price >= 25 THEN 'regex' END AS price_source FROM results""",
    "results",
)
def resolved_prices(spark, sf_dir):
    rows = load(spark, sf_dir, "results").select(
        "result_id", "query", "retailer_key", F.expr("CASE WHEN error IS NULL AND price % 3 < 1 THEN price END").alias("listing_price"), F.col("price").alias("reply_price"), F.col("error").alias("reply_error"),
        F.expr("CASE WHEN original_price IS NULL THEN cast(array() as array<double>) ELSE array(original_price) END").alias("candidates"), F.lit(None).cast("double").alias("page_price"),
    )
    return listings.resolve_price(rows).select("result_id", "price", "price_source")


@query("SELECT result_id, status IN ('ok', 'ok_via_google') AND (coalesce(error = 'product_not_found', false) OR coalesce(price <= 0, true)) AS missing FROM results", "results")
def missing_prices(spark, sf_dir):
    return load(spark, sf_dir, "results").select("result_id", listings.missing_price(F.col("status"), F.col("price"), F.col("error")).alias("missing"))


@query()
def aggregator_listings(spark, sf_dir):
    rows = load(spark, sf_dir, "priced").withColumn("page_text", F.concat_ws("\n", F.lit("Best offers"), F.initcap("retailer_key"), "page_text", F.lit("Amazon"), F.lit("$429.00")))
    return listings.aggregator_listings(rows)


@query(
    """SELECT query, min(price) AS best_price, min_by(retailer_key, (price, retailer_key, original_price IS NOT NULL, original_price)) AS best_retailer, round(max(price) - min(price), 2) AS spread, count(*) AS n_retailers FROM results WHERE price IS NOT NULL GROUP BY query""",
    "results",
)
def price_comparison(spark, sf_dir):
    return listings.price_comparison(load(spark, sf_dir, "results")).select("query", "best_price", "best_retailer", "spread", "n_retailers")


@query("SELECT query, count(*) AS attempted, count(*) FILTER (WHERE status = 'ok') AS success, count(*) FILTER (WHERE status = 'blocked') AS blocked FROM results GROUP BY query", "results")
def search_summary(spark, sf_dir):
    return envelopes.search_summary(load(spark, sf_dir, "results"))


@query(
    """SELECT query, 0 AS part, retailer_key, '{"type":"retailer","data":{"query":"' || query || '","retailer_key":"' || retailer_key || '","status":"' || status || '"}}' AS value FROM results
UNION ALL SELECT query, 1, NULL, '{"type":"summary","data":{"attempted":' || count(*) || ',"success":' || count(*) FILTER (WHERE status = 'ok') || ',"blocked":' || count(*) FILTER (WHERE status = 'blocked') || '}}' FROM results GROUP BY query""",
    "results",
)
def result_lines(spark, sf_dir):
    return envelopes.shop_results_ndjson(load(spark, sf_dir, "results").select("query", "retailer_key", "status"))


# ---- replies


@query(
    """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'salvaged' WHEN page_id % 13 = 0 THEN 'failed' WHEN page_id % 17 = 0 THEN 'inner' ELSE 'direct' END AS how,
  CASE WHEN page_id % 11 = 0 THEN CAST(regexp_extract(reply, '"price": ([0-9.]+)', 1) AS DOUBLE) WHEN page_id % 13 = 0 THEN NULL ELSE CAST(regexp_extract(reply, '"price": ([0-9.]+)', 1) AS DOUBLE) END AS price, CASE WHEN page_id % 11 <> 0 AND page_id % 13 = 0 THEN 'json_parse_failed' END AS error FROM replies""",
    "replies",
)
def parsed_replies(spark, sf_dir):
    rows = replies.parse_replies(load(spark, sf_dir, "replies"))
    return rows.select("page_id", "how", F.get_json_object("parsed", "$.price").cast("double").alias("price"), "error")


_HOW = "CASE WHEN page_id % 11 = 0 THEN 'salvaged' WHEN page_id % 13 = 0 THEN 'failed' WHEN page_id % 17 = 0 THEN 'inner' ELSE 'direct' END"
_TOLD = f"""SELECT *, {_HOW} AS how, CASE WHEN page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 17 = 0 THEN '51.25' ELSE regexp_extract(reply, '"price": ([0-9.]+)', 1) END AS price, regexp_extract(reply, '"regularMarketPrice": ([0-9.]+)', 1) AS header,
  panel * 100000 + page_id AS no FROM replies WHERE page_id % 13 <> 0 OR page_id % 11 = 0"""


@query(
    f"""SELECT payload_id AS page_id, min_by(query, no) FILTER (WHERE how <> 'inner') AS product_name, CAST(min_by(price, no) AS DOUBLE) AS price, CASE WHEN bool_or(how = 'inner') THEN 'inner' END AS title,
  CAST(min_by(header, no) FILTER (WHERE how = 'direct') AS DOUBLE) AS header_price, CASE WHEN bool_or(how = 'direct') THEN count(DISTINCT regexp_extract(reply, '"products": \\[(\\{{[^}}]*\\}})', 1)) FILTER (WHERE how = 'direct') + 1 ELSE 0 END AS n_products FROM ({_TOLD}) AS a GROUP BY 1""",
    "replies",
)
def merged_replies(spark, sf_dir):
    rows = replies.parse_replies(load(spark, sf_dir, "replies")).where("error is null").select(F.col("payload_id").alias("page_id"), F.expr("panel * 100000 + page_id").alias("panel"), "parsed")
    get = lambda path: F.get_json_object("merged", path)
    products = F.coalesce(F.json_array_length(get("$.products")), F.lit(0)).cast("long")
    return replies.merge_partials(rows).select("page_id", get("$.product_name").alias("product_name"), get("$.price").cast("double").alias("price"), get("$.title").alias("title"), get("$.quote_header.regularMarketPrice").cast("double").alias("header_price"), products.alias("n_products"))


_FLAT = f"""SELECT page_id, k.name, CASE k.name WHEN 'vision.product_name' THEN query WHEN 'vision.title' THEN 'inner' WHEN 'vision.price' THEN price ELSE header END AS value
FROM ({_TOLD}) AS t, (SELECT unnest(['vision.product_name', 'vision.price', 'vision.title', 'vision.quote_header.regularMarketPrice']) AS name) AS k
WHERE CASE k.name WHEN 'vision.product_name' THEN how <> 'inner' WHEN 'vision.title' THEN how = 'inner' WHEN 'vision.price' THEN true ELSE how = 'direct' END"""


@query(_FLAT, "replies")
def flat_replies(spark, sf_dir):
    return replies.flatten_reply(replies.parse_replies(load(spark, sf_dir, "replies")), skip=("news", "products"))


@query(f"{_FLAT} UNION ALL SELECT page_id, 'price.regularMarketPrice', header FROM ({_TOLD}) AS b WHERE how = 'direct' UNION ALL SELECT page_id, 'vision.product_name', price FROM ({_TOLD}) AS c WHERE how = 'inner'", "replies")
def promoted_aliases(spark, sf_dir):
    aliases = spark.createDataFrame([("vision.nothing", "price.regularMarketPrice", 0), ("vision.quote_header.regularMarketPrice", "price.regularMarketPrice", 1), ("vision.price", "vision.product_name", 2)], "src string, dst string, pos int")
    return replies.promote_aliases(replies.flatten_reply(replies.parse_replies(load(spark, sf_dir, "replies")), skip=("news", "products")), aliases)


@query(
    f"""SELECT payload_id, min_by(product_name, (price, pos)) AS product_name, min(price) AS price, min_by(seller, (price, pos)) AS seller, count(*) AS n_products, 'vision' AS price_source, true AS has_signal FROM (
  SELECT page_id AS payload_id, query, 0 AS pos, CASE how WHEN 'inner' THEN 'inner' ELSE query END AS product_name, CAST(price AS DOUBLE) AS price, CASE how WHEN 'direct' THEN regexp_extract(reply, '"seller": "([^"]*)"', 1) ELSE '' END AS seller FROM ({_TOLD}) AS a
  UNION ALL SELECT page_id, query, 1, 'other', 77.5, '' FROM ({_TOLD}) AS b WHERE how = 'direct') AS c
WHERE price BETWEEN 25 AND 45000 AND NOT (price = floor(price) AND price BETWEEN 1990 AND 2035) AND price >= CASE WHEN regexp_matches(lower(query), 'osmo|pocket\\s*[34]|action\\s*cam') THEN 280.0 WHEN regexp_matches(lower(query), '\\b(iphone|macbook|ipad\\s*pro|playstation|xbox|gpu|rtx|drone|gimbal)\\b') THEN 120.0 ELSE 25.0 END
GROUP BY payload_id""",
    "replies",
)
def reply_shop_payloads(spark, sf_dir):
    rows = replies.parse_replies(load(spark, sf_dir, "replies")).select(F.col("page_id").alias("payload_id"), "query", "parsed").where("parsed is not null")
    signal = rows.select(F.col("payload_id").alias("p"), replies.has_signal(F.col("parsed")).alias("has_signal"))
    shops = replies.reply_to_shop(rows)
    return shops.join(signal, F.col("p") == F.col("payload_id")).select("payload_id", "product_name", "price", F.coalesce("seller", F.lit("")).alias("seller"), "n_products", "price_source", "has_signal")


@query("SELECT page_id, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN query ELSE 'other' END AS name, 2 AS n_entries FROM (SELECT page_id, query, unnest([0, 1]) AS i FROM replies WHERE page_id % 11 <> 0 AND page_id % 13 <> 0 AND page_id % 17 <> 0) AS a", "replies")
def reply_entries(spark, sf_dir):
    rows = replies.parse_replies(load(spark, sf_dir, "replies")).withColumn("parsed", F.replace("parsed", F.lit('"product_name"'), F.lit('"name"')))
    return replies.explode_reply_list(rows, "products").select("page_id", "pos", "name", F.col("n_entries").cast("int").alias("n_entries"))


# ---- catalog


@query(
    r"""SELECT in_id, canonical_title, brand, model_number, left(concat_ws('|', lower(nullif(brand, '')), lower(nullif(canonical_title, '')), lower(model_number)), 500) AS normalized_key FROM (
  SELECT in_id, trim(regexp_replace(regexp_replace(trim(title), '\s+', ' ', 'g'), '(?i)\b(?:sale|deal|free shipping|limited time|clearance|new lower price)\b', '', 'g')) AS canonical_title,
    CASE WHEN brand IS NULL THEN NULL WHEN in_id % 2 = 0 THEN 'Brand#' || regexp_extract(brand, '#([0-9]+)', 1) || ' Co' ELSE 'Brand#' || regexp_extract(brand, '#([0-9]+)', 1) END AS brand, coalesce(mpn, sku) AS model_number FROM raw_products) AS a""",
    "raw_products",
)
def normalized_products(spark, sf_dir):
    return catalog.normalize_products(load(spark, sf_dir, "raw_products")).select("in_id", "canonical_title", "brand", "model_number", "normalized_key")


_MATCHED = """SELECT i.in_id, i.canonical_title, i.normalized_key, coalesce(g.hit, b.hit, k.hit) AS product_id, CASE WHEN g.hit IS NOT NULL THEN 'gtin_exact' WHEN b.hit IS NOT NULL THEN 'mpn_brand' WHEN k.hit IS NOT NULL THEN 'normalized_key' END AS match_type FROM incoming AS i
LEFT JOIN (SELECT gtin, min(product_id) AS hit FROM products WHERE gtin IS NOT NULL GROUP BY gtin) AS g ON g.gtin = i.gtin
LEFT JOIN (SELECT lower(brand) AS br, mpn, min(product_id) AS hit FROM products GROUP BY 1, 2) AS b ON b.br = lower(i.brand) AND b.mpn = coalesce(i.mpn, i.model_number)
LEFT JOIN (SELECT normalized_key, min(product_id) AS hit FROM products GROUP BY 1) AS k ON k.normalized_key = i.normalized_key"""


@query(f"SELECT in_id, CAST(product_id AS VARCHAR) AS product_id, match_type, CASE match_type WHEN 'gtin_exact' THEN 0.99 WHEN 'mpn_brand' THEN 0.95 WHEN 'normalized_key' THEN 0.93 END AS confidence FROM ({_MATCHED}) AS m", "products", "incoming")
def exact_matches(spark, sf_dir):
    return catalog.match_exact(load(spark, sf_dir, "incoming"), load(spark, sf_dir, "products")).select("in_id", F.col("product_id").cast("string").alias("product_id"), "match_type", "confidence")


@query()
def fuzzy_matches(spark, sf_dir):
    products = load(spark, sf_dir, "products")
    rest = catalog.match_exact(load(spark, sf_dir, "incoming"), products).where("product_id is null").drop("product_id", "match_type", "confidence")
    rest = rest.withColumn("canonical_title", F.concat(F.substring("canonical_title", 2, 1000), F.lit("s")))
    return catalog.match_fuzzy(rest, products)


@query(f"SELECT min(in_id) AS in_id, sha256(normalized_key) AS product_id, 'new_product' AS match_type FROM ({_MATCHED}) AS m WHERE product_id IS NULL AND normalized_key IS NOT NULL GROUP BY normalized_key", "products", "incoming")
def new_products(spark, sf_dir):
    rest = catalog.match_exact(load(spark, sf_dir, "incoming"), load(spark, sf_dir, "products")).where("product_id is null")
    return catalog.new_products(rest).select("in_id", "product_id", "match_type")


_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, coalesce(nullif(title, ''), 'Unknown') ORDER BY observed_at DESC, seq DESC) AS r FROM observed) AS a WHERE r = 1"


_UPSERTED = f"""SELECT CASE WHEN o.source_id IS NOT NULL THEN o.offer_id ELSE sha256(CAST(n.source_id AS VARCHAR) || '|' || n.title) END AS offer_id, o.merchant_name AS merchant_name, coalesce(o.currency, 'USD') AS currency, coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.title, n.title) AS title, coalesce(n.price, o.price) AS price, CASE WHEN o.source_id IS NOT NULL THEN o.availability ELSE n.availability END AS availability,
  CASE WHEN o.source_id IS NOT NULL THEN o.review_count ELSE n.review_count END AS review_count, coalesce(n.url, o.url) AS url, CASE WHEN n.source_id IS NOT NULL THEN timestamp '{AS_OF}' ELSE o.last_seen_at END AS last_seen_at
FROM stored AS o FULL OUTER JOIN (SELECT * REPLACE (coalesce(nullif(title, ''), 'Unknown') AS title) FROM ({_NEWEST}) AS b) AS n ON o.source_id = n.source_id AND o.title = n.title"""


@query(_UPSERTED, "observed", "stored")
def upserted_offers(spark, sf_dir):
    out = catalog.upsert_offers(load(spark, sf_dir, "stored"), load(spark, sf_dir, "observed"), AS_OF)
    return out.select("offer_id", "merchant_name", "currency", "source_id", "title", "price", "availability", "review_count", "url", "last_seen_at")


@query(_UPSERTED, "observed", "stored")
def stored_offers(spark, sf_dir):
    """The same from an offer store that takes the batch twice."""
    known, seen = load(spark, sf_dir, "stored"), load(spark, sf_dir, "observed")
    store = stores.offer_store(spark, new_path(spark, "offers"), known.schema, 16, 2)
    stores.store_rows(store, known)
    version = stores.store_offers(store, seen, AS_OF)
    if stores.store_offers(store, seen, AS_OF) != version:
        raise RuntimeError("the same batch changed the store")
    return store.read().select("offer_id", "merchant_name", "currency", "source_id", "title", "price", "availability", "review_count", "url", "last_seen_at")


@query("SELECT offer_id, price, 'USD' AS currency, availability, captured_at, CAST(CAST(captured_at AS DATE) AS VARCHAR) AS captured_on FROM history WHERE price IS NOT NULL", "history")
def price_history_rows(spark, sf_dir):
    return catalog.append_price_history(load(spark, sf_dir, "history")).withColumn("captured_on", F.col("captured_on").cast("string"))


_NEWEST_HISTORY = """SELECT product_id, offer_id, seq, price, rank FROM (SELECT o.product_id, h.*, row_number() OVER (PARTITION BY o.product_id ORDER BY h.captured_at DESC, h.offer_id, h.seq) AS rank FROM history AS h JOIN offers AS o ON o.offer_id = h.offer_id) AS a WHERE rank <= 200"""


@query(_NEWEST_HISTORY, "offers", "history")
def product_history(spark, sf_dir):
    out = catalog.product_price_history(load(spark, sf_dir, "offers"), load(spark, sf_dir, "history"))
    return out.select("product_id", "offer_id", "seq", "price", F.col("rank").cast("long").alias("rank"))


@query(_NEWEST_HISTORY, "offers", "history")
def kept_history(spark, sf_dir):
    """The same from a history store that takes a batch for each year, none of them in order."""
    rows = load(spark, sf_dir, "history").join(load(spark, sf_dir, "offers").select("offer_id", "product_id"), "offer_id")
    rows = materialize(rows.withColumn("part", F.pmod(F.year("captured_at") * 5, F.lit(3))), "history")
    store = stores.history_store(spark, new_path(spark, "history"), buckets=16)
    for part in (0, 1, 2, 1):
        stores.keep_history(store, rows.where(F.col("part") == part))
    return stores.stored_history(store).select("product_id", "offer_id", "seq", "price", F.col("rank").cast("long").alias("rank"))


@query("SELECT o.offer_id, o.product_id FROM offers AS o WHERE o.product_id IN (SELECT product_id FROM products WHERE canonical_title ILIKE '%red_w%' ORDER BY product_id LIMIT 50)", "offers", "products")
def searched_offers(spark, sf_dir):
    index = build_title_index(load(spark, sf_dir, "products"), new_path(spark, "titles"))
    found = catalog.search_products(index, spark.createDataFrame([("red_w",)], "query string"))
    return catalog.product_offers(found, load(spark, sf_dir, "offers")).select("offer_id", "product_id")


@query(
    """SELECT query, product_id, rank FROM (SELECT s.query, p.product_id, row_number() OVER (PARTITION BY s.query ORDER BY p.product_id) AS rank
  FROM searches AS s JOIN products AS p ON p.canonical_title ILIKE '%' || lower(s.query) || '%') AS a WHERE rank <= 50""",
    "searches", "products",
)
def title_searches(spark, sf_dir):
    index = build_title_index(load(spark, sf_dir, "products"), new_path(spark, "titles"))
    return catalog.search_products(index, load(spark, sf_dir, "searches")).select("query", "product_id", F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT retailer_key, source_id, 'active' AS status, CASE WHEN status <> 'active' THEN true ELSE allowed END AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY retailer_key ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, source_id) AS r FROM sources WHERE status = 'active' OR source_type = 'managed_retailer_search') AS a WHERE r = 1""",
    "sources",
)
def picked_sources(spark, sf_dir):
    return catalog.pick_sources(load(spark, sf_dir, "sources")).select("retailer_key", "source_id", "status", "allowed")


@query("SELECT source_id, name, CASE WHEN source_id % 10 = 0 THEN 'active' WHEN source_id % 10 = 1 THEN 'paused' ELSE status END AS status, CASE WHEN source_id % 10 = 0 THEN true ELSE allowed END AS allowed FROM sources", "sources")
def patched_sources(spark, sf_dir):
    rows = load(spark, sf_dir, "sources")
    patches = rows.where("source_id % 10 < 2").select("source_id", F.lit(None).cast("string").alias("name"), F.expr("CASE source_id % 10 WHEN 0 THEN 'active' ELSE 'paused' END").alias("status"), F.lit(None).cast("boolean").alias("allowed"))
    return catalog.apply_source_patches(rows, patches).select("source_id", "name", "status", "allowed")


@query(
    """SELECT source_id, retailer_key, CASE WHEN source_type = 'managed_retailer_search' THEN 'active' ELSE status END AS status, source_type = 'managed_retailer_search' AND status <> 'active' OR allowed AS allowed FROM sources WHERE retailer_key <> 'target'
UNION ALL SELECT DISTINCT -1, 'target', 'active', true FROM sources""",
    "sources",
)
def seeded_sources(spark, sf_dir):
    rows = load(spark, sf_dir, "sources")
    existing = rows.where("retailer_key <> 'target'").select("source_id", "retailer_key", "status", "source_type", "allowed")
    seed = rows.select("retailer_key").distinct().select(F.lit(-1).cast("long").alias("source_id"), "retailer_key", F.lit("active").alias("status"), F.lit(catalog.MANAGED).alias("source_type"), F.lit(True).alias("allowed"))
    return catalog.seed_sources(existing, seed).select("source_id", "retailer_key", "status", "allowed")


@query(
    """SELECT 'T' || p_partkey AS ticker, CASE t.n WHEN 0 THEN 'https://finance.example.com/quote/T' || p_partkey ELSE 'https://other.example.com/T' || p_partkey || '/news?s=T' || p_partkey END AS url
FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS pos FROM part) AS p, (SELECT unnest([0, 1]) AS n) AS t WHERE pos <= 50"""
)
def ticker_urls(spark, sf_dir):
    order = Window.orderBy(F.desc("p_size"), "p_partkey")
    best = table(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_partkey").limit(50)
    tickers = best.select(F.concat(F.lit("T"), "p_partkey").alias("ticker"), F.row_number().over(order).alias("pos"))
    templates = spark.createDataFrame([("https://finance.example.com/quote/{ticker}",), ("https://other.example.com/{ticker}/news?s={ticker}",)], "template string")
    return catalog.expand_ticker_urls(tickers, templates)


@query(
    """SELECT q.query, r.retailer_key, CASE WHEN t.search_url_template IS NOT NULL THEN replace(t.search_url_template, '{query}', replace(q.query, ' ', '+')) END AS url, CASE WHEN t.search_url_template IS NULL THEN 'source_not_configured' END AS error
FROM (SELECT DISTINCT p_name AS query FROM part) AS q CROSS JOIN (SELECT unnest(['walmart', 'ebay', 'newegg']) AS retailer_key) AS r LEFT JOIN (SELECT retailer_key, max(search_url_template) AS search_url_template FROM sources GROUP BY 1) AS t ON t.retailer_key = r.retailer_key""",
    "sources",
)
def search_urls(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.col("p_name").alias("query")).distinct()
    retailers = spark.createDataFrame([("walmart",), ("ebay",), ("newegg",)], "retailer_key string")
    sources = load(spark, sf_dir, "sources").groupBy("retailer_key").agg(F.max("search_url_template").alias("search_url_template"))
    return catalog.expand_search_urls(asked, retailers, sources)


# ---- compliance

_GATE = "CASE WHEN source_type IN ('google_shopping', 'google_shopping_scrape') THEN 'google_shopping_direct_scrape_rejected' WHEN {0} IN ('paused', 'blocked_or_rate_limited', 'disallowed_by_robots', 'disallowed_by_terms', 'error') THEN 'source_status_' || {0} WHEN {0} <> 'active' THEN 'source_not_active' ELSE 'ok' END"


@query(f"SELECT source_id, {_GATE.format('status')} = 'ok' AS allowed, {_GATE.format('status')} AS reason FROM sources", "sources")
def source_gates(spark, sf_dir):
    allowed, reason = compliance.source_gate(F.col("source_type"), F.col("status"))
    return load(spark, sf_dir, "sources").select("source_id", allowed.alias("allowed"), reason.alias("reason"))


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


_BLOCK = (
    "CASE WHEN http_status = 403 THEN 'access_denied' WHEN http_status = 429 THEN 'rate_limited' WHEN contains(lower(url), '/blocked') THEN 'access_denied' WHEN "
    + _any("lower(left(text, 4000))", compliance.STRONG) + " THEN 'captcha_detected' "
    + " ".join(f"WHEN length(text) < 15000 AND contains(lower(left(text, 12000)), '{w}') THEN '{r}'" for w, r in compliance.KEYWORDS)
    + f" WHEN length(text) < 2000 AND {_any('lower(left(text, 12000))', compliance.SHORT_WORDS)} THEN 'captcha_detected' WHEN length(text) < 2500 AND {_any('lower(left(text, 4000))', compliance.ERROR_WORDS)} THEN 'access_denied' ELSE 'ok' END"
)


@query(f"SELECT fetch_id, reason, reason <> 'ok' AND tier = 1 AS escalate, reason <> 'ok' AND tier >= 4 AS stop FROM (SELECT *, {_BLOCK} AS reason FROM fetches) AS a", "fetches")
def block_reasons(spark, sf_dir):
    rows = load(spark, sf_dir, "fetches").withColumn("reason", compliance.classify_block(F.col("text"), F.col("http_status"), F.col("url")))
    escalate, stop = compliance.escalation_decision(F.col("reason"), F.col("tier"))
    return rows.select("fetch_id", "reason", escalate.alias("escalate"), stop.alias("stop"))


_VENDOR = "CASE " + " ".join(f"WHEN {_any('blob', [m.replace(chr(39), chr(39) * 2) for m in marks])} THEN '{v}'" for v, marks in compliance.VENDORS.items()) + " END"


@query(
    f"""SELECT fetch_id, {_any("lower(url)", ("/blocked", "challenge"))} OR {_any("lower(title)", compliance.TITLE_WORDS)} OR {_any("lower(left(text, 12000))", compliance.BODY_WORDS)}
  OR coalesce(retailer_key IN ('ebay', 'walmart', 'amazon', 'target', 'bestbuy'), false) AND length(text) < 2000 OR length(text) < 2500 AND {_any("lower(left(text, 12000))", compliance.SHORT_WORDS)} AS blocked, {_VENDOR} AS vendor
FROM (SELECT *, lower(url || chr(10) || html || CASE fetch_id % 6 WHEN 0 THEN 'px-captcha' WHEN 1 THEN 'g-recaptcha' WHEN 2 THEN 'Just a moment' ELSE '' END || chr(10) || text) AS blob FROM fetches) AS a""",
    "fetches",
)
def likely_blocked(spark, sf_dir):
    rows = load(spark, sf_dir, "fetches")
    marked = F.concat("html", F.expr("CASE fetch_id % 6 WHEN 0 THEN 'px-captcha' WHEN 1 THEN 'g-recaptcha' WHEN 2 THEN 'Just a moment' ELSE '' END"))
    blocked = compliance.likely_blocked(F.col("url"), F.col("title"), F.col("text"), F.length("text"), F.col("retailer_key"))
    return rows.select("fetch_id", blocked.alias("blocked"), compliance.wall_vendor(marked, F.col("url"), F.col("text")).alias("vendor"))


_MARKED = "CASE retailer_key " + " ".join(f"WHEN '{k}' THEN {_any('lower(left(page, 120000))', [m.lower() for m in marks])}" for k, marks, _ in compliance.PROFILES) + " ELSE true END"
_MIN = "CASE retailer_key " + " ".join(f"WHEN '{k}' THEN {n}" for k, _, n in compliance.PROFILES) + " END"


@query(
    f"""SELECT fetch_id, status = 'ok' AND (fetch_backend = 'browser_grid' OR {_MARKED} OR fetch_backend = 'brightdata_scraping_browser' AND length(html) >= {_MIN} AND NOT {_any("lower(title)", compliance.ERROR_TITLES)}) AS usable
FROM (SELECT *, html || CASE WHEN fetch_id % 2 = 0 THEN '<i class="S-CARD">' ELSE '' END AS page FROM fetches) AS a""",
    "fetches",
)
def usable_pages(spark, sf_dir):
    rows = load(spark, sf_dir, "fetches").withColumn("char_count", F.length("html")).withColumn("html", F.concat("html", F.expr("CASE WHEN fetch_id % 2 = 0 THEN '<i class=\"S-CARD\">' ELSE '' END")))
    return compliance.usable_pages(rows, compliance.profiles(spark)).select("fetch_id", "usable")


_EVENTS = f"""SELECT fetch_id, source_id, source_type, http_status, created_at, unnest(list_filter([
  CASE WHEN gate <> 'ok' THEN {{'event_type': 'source_paused', 'message': gate, 'final_status': 'rejected'}} END,
  CASE WHEN gate = 'ok' AND NOT robots_ok THEN {{'event_type': 'robots_disallowed', 'message': 'disallowed_by_robots', 'final_status': 'rejected'}} END,
  CASE WHEN gate = 'ok' AND robots_ok AND reason <> 'ok' AND tier = 1 AND escalate_on_block THEN {{'event_type': 'captcha_detected', 'message': reason, 'final_status': 'escalated'}} END,
  CASE WHEN gate = 'ok' AND robots_ok AND failed THEN {{'event_type': CASE WHEN stop AND contains(reason, 'captcha') THEN 'captcha_detected' ELSE 'access_denied' END, 'message': CASE WHEN stop THEN reason ELSE 'fetch_failed' END, 'final_status': 'blocked'}} END,
  CASE WHEN gate = 'ok' AND robots_ok AND NOT failed AND status = 'ok' THEN {{'event_type': 'fetch_success', 'message': 'ok', 'final_status': 'ok'}} END], lambda e: e IS NOT NULL)) AS e
FROM (SELECT *, stop OR status = 'error' AS failed FROM (SELECT *, reason <> 'ok' AND tier >= 4 AS stop FROM (SELECT *, {_GATE.format("source_status")} AS gate, {_BLOCK} AS reason FROM fetches) AS a) AS b) AS c"""


@query(f"SELECT fetch_id, source_id, http_status, e.event_type AS event_type, e.message AS message, e.final_status AS final_status FROM ({_EVENTS}) AS d", "fetches")
def fetch_events(spark, sf_dir):
    return compliance.fetch_outcomes(load(spark, sf_dir, "fetches")).select("fetch_id", "source_id", "http_status", "event_type", "message", "final_status")


@query(f"SELECT s.source_id, CASE WHEN b.source_id IS NOT NULL AND s.source_type <> 'managed_retailer_search' THEN 'blocked_or_rate_limited' ELSE s.status END AS status FROM sources AS s LEFT JOIN (SELECT DISTINCT source_id FROM ({_EVENTS}) AS d WHERE e.event_type IN ('captcha_detected', 'access_denied', 'rate_limited')) AS b ON b.source_id = s.source_id", "fetches", "sources")
def event_statuses(spark, sf_dir):
    events = compliance.fetch_outcomes(load(spark, sf_dir, "fetches"))
    return compliance.apply_event_status(load(spark, sf_dir, "sources"), events).select("source_id", "status")


@query("SELECT seq AS event_id, created_at, status FROM log ORDER BY created_at DESC, seq LIMIT 100", "log")
def recent_events(spark, sf_dir):
    return compliance.recent_events(load(spark, sf_dir, "log").select(F.col("seq").alias("event_id"), "created_at", "status"))


_HITS = "CASE coalesce(block_reason, 'blocked') " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in compliance.HITS.items()) + " ELSE 'behavioral_ml' END"
_WHY = "CASE WHEN block_reason IS NULL THEN 'blocked' " + " ".join(f"WHEN block_reason = '{k}' THEN '{v}'" for k, v in compliance.REASONS.items()) + " ELSE block_reason END"


@query(f"SELECT fetch_id, CASE tier WHEN 1 THEN 'static_api' WHEN 2 THEN 'js_rendered' WHEN 3 THEN 'advanced_antibot' ELSE 'bank_grade' END AS tier_name, CASE WHEN block_reason IS NOT NULL OR status = 'blocked' THEN {_HITS} ELSE '' END AS hits, {_WHY} AS canonical_reason FROM fetches", "fetches")
def annotated_envelopes(spark, sf_dir):
    return compliance.annotate_envelope(load(spark, sf_dir, "fetches")).select("fetch_id", "tier_name", F.array_join("detection_hits", ",").alias("hits"), "canonical_reason")


@query()
def admitted_requests(spark, sf_dir):
    rows = load(spark, sf_dir, "log").select(F.concat(F.lit("host"), (F.col("user_id") % 40).cast("string")).alias("domain"), F.col("seq").alias("request_id"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6 / 60).alias("requested_at"), F.expr("CASE WHEN user_id % 3 = 0 THEN 5.0 END").cast("double").alias("delay"), F.expr("CASE WHEN user_id % 4 = 0 THEN 3 END").alias("max_rpm"))
    return compliance.admit_requests(rows)


_ROBOT_URL = "'/' || CASE page_id % 3 WHEN 0 THEN 'en/x' WHEN 1 THEN 'de/y?q=1' ELSE '' END"


@query(
    f"""SELECT page_id, 'https://h' || page_id || '.example.com' || path AS url, reason = 'allowed_by_robots' AS allowed, reason FROM (SELECT page_id, path, CASE WHEN page_id % 4 = 0 THEN 'robots_unavailable' WHEN page_id % 4 = 1 AND starts_with(path, '/en/') OR page_id % 4 = 2 AND NOT starts_with(path, '/de/') THEN 'disallowed_by_robots' ELSE 'allowed_by_robots' END AS reason
FROM (SELECT page_id, {_ROBOT_URL} AS path FROM pages) AS a) AS b"""
)
def robots_decisions(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", F.expr(f"'https://h' || page_id || '.example.com' || {_ROBOT_URL}").alias("url"))
    said = F.expr(r"CASE page_id % 4 WHEN 1 THEN 'User-agent: *\nDisallow: /en/ # no\nAllow: /' WHEN 2 THEN 'User-agent: *\nDisallow: /x\n\nUser-agent: PriceBot\nAllow: /de/\nDisallow: /\n' WHEN 3 THEN 'User-agent: other\nDisallow: /' END")
    rules = urls.select(F.expr("'https://h' || page_id || '.example.com'").alias("host_key"), said.alias("rules"))
    return compliance.robots_gate(urls, rules, "pricebot").select("page_id", "url", "allowed", "reason")


# ---- metrics

_KNOWN = "CASE WHEN status IN ('ok', 'blocked', 'error') THEN status ELSE 'error' END"
_COST = "CASE provider " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in metrics.COSTS.items()) + " ELSE 0.0 END"


@query(
    f"""SELECT provider, attempts, success, blocked, errors, CAST(printf('%.1f', 100 * blocked / attempts) AS DOUBLE) AS block_rate_pct, CAST(printf('%.1f', 100 * success / attempts) AS DOUBLE) AS success_rate_pct, CAST(round_even(ms / attempts, 0) AS BIGINT) AS avg_latency_ms, CAST({_COST} AS DOUBLE) AS cost_per_success_usd, CAST(printf('%.4f', success * CAST({_COST} AS DOUBLE)) AS DOUBLE) AS total_cost_usd
FROM (SELECT provider, count(*) AS attempts, count(*) FILTER (WHERE s = 'ok') AS success, count(*) FILTER (WHERE s = 'blocked') AS blocked, count(*) FILTER (WHERE s = 'error') AS errors, sum(ms) AS ms FROM (SELECT provider, {_KNOWN} AS s, CAST(floor(latency_ms) AS BIGINT) AS ms FROM log) AS a GROUP BY provider) AS b""",
    "log",
)
def provider_dashboard(spark, sf_dir):
    return metrics.provider_dashboard(load(spark, sf_dir, "log"))


@query(f"SELECT retailer_key, count(*) FILTER (WHERE s = 'ok') AS ok, count(*) FILTER (WHERE s = 'blocked') AS blocked, count(*) FILTER (WHERE s = 'error') AS error FROM (SELECT retailer_key, {_KNOWN} AS s FROM log WHERE retailer_key IS NOT NULL) AS a GROUP BY retailer_key", "log")
def retailer_dashboard(spark, sf_dir):
    return metrics.retailer_dashboard(load(spark, sf_dir, "log"))


@query(f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, CAST(printf('%.4f', sum(CAST({_COST} AS DOUBLE))) AS DOUBLE) AS spend, sum(CAST({_COST} AS DOUBLE)) > 1.2 AS over_budget FROM log WHERE status = 'ok' GROUP BY 1", "log")
def daily_spend(spark, sf_dir):
    return metrics.daily_spend(load(spark, sf_dir, "log"), 1.2).withColumn("day", F.col("day").cast("string"))


_CLASS = r"CASE WHEN regexp_matches(coalesce(error, ''), 'browser_grid_timeout|browser_grid_enqueue') THEN 'ignored_queue' WHEN lower(trim(coalesce(error, ''))) = 'ok' OR regexp_matches(coalesce(error, ''), '(?i)captcha|access_denied|no_product_list|login_required|rate_limited|verify you are human|robot check|bot detection|blocked') THEN 'ignored_wall' WHEN regexp_matches(coalesce(error, ''), '(?i)customer_suspended|account is suspended|auth failed|billing|insufficient.?balance|quota.?exceeded') THEN 'suspension' ELSE 'other' END"


@query(f"SELECT provider, {_CLASS} AS class, count(*) AS n FROM log WHERE status <> 'ok' GROUP BY 1, 2", "log")
def failure_classes(spark, sf_dir):
    rows = load(spark, sf_dir, "log").where("status <> 'ok'")
    return rows.groupBy("provider", metrics.classify_failure(F.col("error")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT provider, failures, CASE WHEN s THEN 'suspended_or_billing' END AS disabled_reason, s OR failures >= 5 AS is_open FROM (
  SELECT provider, count(*) FILTER (WHERE NOT ok AND class IN ('suspension', 'other') AND (last_ok IS NULL OR seq > last_ok)) AS failures, coalesce(bool_or(NOT ok AND class = 'suspension'), false) AS s FROM (
    SELECT *, max(CASE WHEN ok THEN seq END) OVER (PARTITION BY provider) AS last_ok FROM (SELECT provider, seq, status = 'ok' AND seq % 50 < 40 AS ok, {_CLASS} AS class FROM log WHERE provider <> 'proxy_http' OR coalesce(error, '') NOT IN ('customer_suspended', 'insufficient balance')) AS a) AS b GROUP BY provider) AS c""",
    "log",
)
def circuit_states(spark, sf_dir):
    rows = load(spark, sf_dir, "log").where("provider <> 'proxy_http' OR coalesce(error, '') NOT IN ('customer_suspended', 'insufficient balance')")
    return metrics.circuit_state(rows.withColumn("ok", F.expr("status = 'ok' AND seq % 50 < 40"))).select("provider", "failures", "disabled_reason", "is_open")


@query(
    """SELECT user_id, successes, failures, CASE WHEN successes + failures = 0 THEN 0.5 ELSE CAST(printf('%.2f', successes / (successes + failures)) AS DOUBLE) END AS health FROM (
  SELECT user_id, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR seq > last_ok)) AS failures FROM (SELECT user_id, seq, status = 'ok' AS ok, max(CASE WHEN status = 'ok' THEN seq END) OVER (PARTITION BY user_id) AS last_ok FROM log) AS a GROUP BY user_id) AS b""",
    "log",
)
def endpoint_health(spark, sf_dir):
    return metrics.endpoint_health(load(spark, sf_dir, "log").withColumn("ok", F.col("status") == "ok"), ["user_id"]).select("user_id", "successes", "failures", "health")


@query("SELECT ticker, string_split(name, '.')[1] AS field_group, count(DISTINCT name) AS n_fields, CAST(sum(count(DISTINCT name)) OVER (PARTITION BY ticker) AS BIGINT) AS field_count FROM flat GROUP BY 1, 2", "flat")
def field_groups(spark, sf_dir):
    return metrics.field_groups(load(spark, sf_dir, "flat"))


@query("SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS run_id, count(*) FILTER (WHERE status = 'ok') AS saved, count(*) FILTER (WHERE status <> 'ok') AS errors FROM log GROUP BY 1", "log")
def fetch_tally(spark, sf_dir):
    return metrics.fetch_tally(load(spark, sf_dir, "log").withColumn("run_id", F.to_date("created_at").cast("string")))


# ---- finance

_SYMBOL = "'S' || CAST(page_id AS STRING)"
_QUOTE_PAGE = """html || '<script>{"symbol":"BTC-USD","regularMarketPrice":{"raw":99999.5}}</script><script>{"symbol":"S' || CAST(page_id AS STRING) || '","shortName":"Name ' || CAST(page_id AS STRING) || '","regularMarketPrice":{"raw":' || CAST(page_id + 10 AS STRING) || '.25,"fmt":"x"},"marketCap":' || CAST(page_id * 1000 AS STRING) || '}</script>' || '<fin-streamer class="a" data-symbol="S' || CAST(page_id AS STRING) || '" data-field="regularMarketVolume" value="1,2' || CAST(page_id AS STRING) || '">' || CASE WHEN page_id % 2 = 0 THEN '<b data-test="qsp-price">1,0' || CAST(page_id % 10 AS STRING) || '5.5</b>' ELSE '' END"""


def _quote_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_SYMBOL).alias("symbol"), F.expr(_QUOTE_PAGE).alias("html"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'AB.' || page_id WHEN 1 THEN 'X-USD' END AS ticker FROM pages")
def quote_tickers(spark, sf_dir):
    url = F.expr("CASE page_id % 3 WHEN 0 THEN 'https://Finance.yahoo.com/quote/ab.' || page_id || '/news' WHEN 1 THEN 'https://finance.yahoo.com/quote/x-usd?p=1' ELSE url END")
    return table(spark, sf_dir, "pages").select("page_id", finance.quote_ticker(url).alias("ticker"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS ticker, k.key, CASE k.key WHEN 'price.regularMarketPrice' THEN p_size || '.5' WHEN 'price.shortName' THEN '"' || p_name || '"' WHEN 'price.deep.er' THEN '"y"' WHEN 'trend.list' THEN '[]' WHEN 'trend.rows' THEN '[{"a":1},{"c":3}]' ELSE '["x",1]' END AS value_json
FROM part, (SELECT unnest(['price.regularMarketPrice', 'price.shortName', 'price.deep.er', 'trend.list', 'trend.rows', 'trend.tags']) AS key) AS k"""
)
def flat_modules(spark, sf_dir):
    made = F.expr("""'{"price": {"regularMarketPrice": {"raw": ' || p_size || '.5, "fmt": "x"}, "shortName": "' || p_name || '", "gone": null, "empty": {}, "deep": {"er": {"fmt": "y"}}}, "trend": {"list": [], "rows": [{"a": {"raw": 1}, "b": 2}, {"c": 3}], "tags": ["x", 1]}, "n": 3}'""")
    return finance.flatten_modules(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("ticker"), made.alias("modules")))


@query(
    """SELECT page_id, k.name, CASE k.name WHEN 'shortName' THEN 'Name ' || page_id WHEN 'regularMarketPrice' THEN CAST(CAST(page_id + 10.25 AS DOUBLE) AS VARCHAR) WHEN 'marketCap' THEN CAST(CAST(page_id * 1000 AS DOUBLE) AS VARCHAR) ELSE CAST(CAST('12' || page_id AS DOUBLE) AS VARCHAR) END AS value
FROM pages, (SELECT unnest(['shortName', 'regularMarketPrice', 'marketCap', 'regularMarketVolume']) AS name) AS k"""
)
def scoped_fields(spark, sf_dir):
    return finance.scoped_quote_fields(_quote_pages(spark, sf_dir))


@query("SELECT page_id, 'regularMarketVolume' AS name, CAST(CAST('12' || page_id AS DOUBLE) AS VARCHAR) AS value FROM pages")
def streamer_fields(spark, sf_dir):
    return finance.streamer_fields(_quote_pages(spark, sf_dir))


@query("SELECT page_id, CAST(page_id + 10.25 AS DOUBLE) AS price FROM pages")
def regular_prices(spark, sf_dir):
    return finance.regular_price(_quote_pages(spark, sf_dir))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST('10' || page_id % 10 || '5.5' AS DOUBLE) ELSE page_id + 10.25 END AS price FROM pages")
def page_quotes(spark, sf_dir):
    rows = finance.page_quote_fields(_quote_pages(spark, sf_dir).withColumn("candidates", F.array(F.lit(1.5))))
    return rows.where("name = 'asp.regularMarketPrice'").select("page_id", F.col("value").cast("double").alias("price"))


_MERGED = """SELECT ticker, name, value FROM (SELECT *, max(CASE WHEN name = 'vision.regularMarketPrice' THEN CAST(value AS DOUBLE) END) OVER (PARTITION BY ticker) AS seen FROM (SELECT ticker, name, max_by(value, prio) AS value FROM flat WHERE NOT starts_with(name, 'vision.news') GROUP BY 1, 2) AS a) AS b
WHERE seen IS NULL OR seen = 0 OR name NOT IN ('asp.regularMarketPrice', 'html.regularMarketPrice', 'dom.regularMarketPrice') OR try_cast(value AS DOUBLE) = seen"""


@query(_MERGED, "flat")
def merged_quotes(spark, sf_dir):
    return finance.merge_quote_sources(load(spark, sf_dir, "flat"))


_PICK = "max(CASE WHEN name = '{0}' AND coalesce(try_cast(value AS DOUBLE), 1) <> 0 THEN value END)"


@query(
    f"""SELECT ticker, CAST(coalesce({_PICK.format('vision.regularMarketPrice')}, {_PICK.format('asp.regularMarketPrice')}, {_PICK.format('html.regularMarketPrice')}) AS DOUBLE) AS "regularMarketPrice", CAST(coalesce({_PICK.format('summaryDetail.trailingPE')}, {_PICK.format('asp.trailingPE')}) AS DOUBLE) AS "trailingPE", {_PICK.format('asp.shortName')} AS "shortName" FROM ({_MERGED}) AS m GROUP BY ticker""",
    "flat",
)
def smart_quotes(spark, sf_dir):
    return finance.smart_quote(finance.merge_quote_sources(load(spark, sf_dir, "flat"))).select("ticker", "regularMarketPrice", "trailingPE", "shortName")


@query(
    f"SELECT a.ticker, a.price, true AS has_price FROM (SELECT ticker, round(CAST(min_by(value, CASE name WHEN 'asp.regularMarketPrice' THEN 1 WHEN 'vision.regularMarketPrice' THEN 3 ELSE 5 END) AS DOUBLE), 4) AS price FROM ({_MERGED}) AS m WHERE name IN ('asp.regularMarketPrice', 'vision.regularMarketPrice', 'html.regularMarketPrice') AND try_cast(value AS DOUBLE) > 0 GROUP BY ticker) AS a",
    "flat",
)
def quote_prices(spark, sf_dir):
    flat = finance.merge_quote_sources(load(spark, sf_dir, "flat"))
    return finance.quote_price(flat).join(finance.has_quote_price(flat), "ticker")


@query(
    """SELECT p_partkey AS feed_id, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN 'About ' || p_name ELSE 'Second item' END AS title, CASE i WHEN 0 THEN 'https://n.example.com/' || p_partkey ELSE '' END AS link, CASE i WHEN 0 THEN 'a  b  c' ELSE '' END AS summary, 'Yahoo Finance' AS publisher FROM (SELECT *, unnest([0, 1]) AS i FROM part) AS a"""
)
def rss_articles(spark, sf_dir):
    made = F.expr("""'<rss><item><link>no title</link></item><item><title><![CDATA[About  ' || p_name || ' ]]></title><link>https://n.example.com/' || p_partkey || ' </link><description><![CDATA[a <b>b</b> c]]></description></item><ITEM><title>Second item</title></ITEM></rss>'""")
    return finance.rss_articles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feed_id"), made.alias("rss")))


@query("SELECT page_id, CAST(i AS INT) AS pos, CASE i WHEN 0 THEN 'Headline about ' || query ELSE 'Second headline here' END AS title, CASE i WHEN 0 THEN '/news/' || page_id ELSE '/news/two' END AS link, 'Yahoo Finance' AS publisher FROM (SELECT *, unnest([0, 1]) AS i FROM priced WHERE contains(html, '<h3>Headline about')) AS a", "priced")
def html_articles(spark, sf_dir):
    return finance.html_articles(load(spark, sf_dir, "priced"))


# ---- whole workloads


def shop_inputs(spark, sf_dir):
    """Pages, replies (some in two parts, with the product's mpn in the second), sources, products and offers of one batch."""
    fetched = load(spark, sf_dir, "priced").withColumns({
        "source_id": F.expr("page_id % 97 + 1"), "status": F.expr("CASE WHEN page_id % 8 = 5 THEN 'error' ELSE 'ok' END"), "http_status": F.expr("CASE page_id % 10 WHEN 3 THEN 403 ELSE 200 END"),
        "tier": F.expr("CAST(page_id % 4 + 1 AS INT)"), "page_text": F.concat("page_text", F.expr("repeat(' filler', 400)")), "fetch_backend": F.expr("CASE WHEN page_id % 4 = 2 THEN 'browser_grid' ELSE 'curl' END"),
    })
    said = load(spark, sf_dir, "replies").where("page_id % 3 <> 1").select("page_id", "query", "panel", "reply")
    more = F.concat(F.lit('{"price": null, "seller": "second", "rating": 4.5, "mpn": "M'), "page_id", F.lit('"}'))
    said = said.unionByName(said.where("page_id % 3 = 2").withColumns({"panel": F.col("panel") + 1, "reply": more}))
    stored = load(spark, sf_dir, "stored").withColumn("product_id", F.col("product_id").cast("string"))
    return fetched, said, load(spark, sf_dir, "sources"), load(spark, sf_dir, "products"), stored


def _shopped(spark, sf_dir):
    return shopping.pages_to_offers(*shop_inputs(spark, sf_dir), AS_OF)


@query()
def shop_results(spark, sf_dir):
    """Every page with its price and where it came from, its product, or why it dropped out."""
    return _shopped(spark, sf_dir).results.select("page_id", "product_name", "price", "price_source", "brand", "mpn", "gtin", "error", "product_id", "match_type", "confidence", "needs_review")


@query()
def shop_products(spark, sf_dir):
    """The products that the batch adds to the catalog."""
    return _shopped(spark, sf_dir).products.select("product_id", "canonical_title", "brand", "model_number", "mpn", "gtin", "normalized_key")


@query()
def shop_history(spark, sf_dir):
    """The price history rows that the batch adds."""
    return _shopped(spark, sf_dir).history.select("offer_id", "price", "currency", "availability", "captured_at")


@query()
def pages_to_offers(spark, sf_dir):
    """Every offer after the batch."""
    return _shopped(spark, sf_dir).offers.select("offer_id", "source_id", "title", "product_id", "price", "availability", "url", "last_seen_at")


@query(
    f"""SELECT r.provider, r.attempts, r.success, f.failures, CASE WHEN d.over AND r.provider IN ('brightdata_scraping_browser', 'brightdata_unlocker', 'external_scrapfly') THEN 'daily_budget_exceeded' WHEN f.s THEN 'suspended_or_billing' END AS disabled_reason
FROM (SELECT provider, count(*) AS attempts, count(*) FILTER (WHERE status = 'ok') AS success FROM log GROUP BY 1) AS r
JOIN (SELECT provider, count(*) FILTER (WHERE failed AND (last_ok IS NULL OR seq > last_ok)) AS failures, coalesce(bool_or(broke), false) AS s
  FROM (SELECT provider, seq, status <> 'ok' AND class IN ('suspension', 'other') AS failed, status <> 'ok' AND class = 'suspension' AS broke, max(CASE WHEN status = 'ok' THEN seq END) OVER (PARTITION BY provider) AS last_ok FROM (SELECT *, {_CLASS} AS class FROM log) AS a) AS b GROUP BY 1) AS f ON f.provider = r.provider
CROSS JOIN (SELECT max_by(over, day) AS over FROM (SELECT CAST(created_at AS DATE) AS day, sum(CAST({_COST} AS DOUBLE)) > 1.2 AS over FROM log WHERE status = 'ok' GROUP BY 1) AS c) AS d""",
    "log",
)
def log_to_dashboards(spark, sf_dir):
    made = crawl.log_to_dashboards(load(spark, sf_dir, "fetches"), load(spark, sf_dir, "sources"), load(spark, sf_dir, "log"), 1.2)
    return made.providers.join(made.circuits, "provider").select("provider", "attempts", "success", "failures", "disabled_reason")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
