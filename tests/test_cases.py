"""Small hand-worked cases of single operators, and the helpers against plain loops."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from pricetide.functions import helpers, prices, text
from pricetide.operators import catalog, compliance, finance, listings, metrics, pages, ranking, replies


def one(spark, column, **values):
    row = spark.range(1).select(*[(F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


# ---- prices


def html_prices(spark, html, retailer):
    return one(spark, prices.html_price_candidates(F.col("h"), F.col("r")), h=html, r=retailer)


def test_retailer_page(spark):
    html = '<script>{"currentPrice": 512.00}</script><div data-automation-id="product-price">$419.00</div><div class="x">$12.99</div>'
    assert 419.0 in html_prices(spark, html, "walmart") and 12.99 not in html_prices(spark, html, "walmart")
    assert 512.0 not in html_prices(spark, html, "walmart")


def test_auction_page(spark):
    html = '<span class="s-item__price">$389.99</span><span class="s-item__price">$9.99</span>'
    assert html_prices(spark, html, "ebay") == [389.99]
    assert html_prices(spark, "", "ebay") == [] and html_prices(spark, None, None) == []


def test_visible_text(spark):
    assert one(spark, prices.text_price_candidates(F.col("t")), t="DJI Osmo Pocket 3 Now $419.00 Free shipping Case $14.99") == [419.0]
    assert one(spark, prices.text_price_candidates(F.col("t")), t="$1,299.99 $49.5 $ 1999 $45001") == [49.0, 1299.0]


@pytest.mark.parametrize(
    ("found", "query", "retailer", "best"),
    [
        ([419.0, 429.0, 14.99], "DJI Osmo Pocket 3", "walmart", 419.0),
        ([419.0, 539.0], "camera", "target", 419.0),
        ([30.0, 35.0, 500.0], "camera", "other", 500.0),
        ([], "camera", "target", None),
        ([30.0], "iphone", "ebay", 30.0),
    ],
)
def test_best_price(spark, found, query, retailer, best):
    row = spark.createDataFrame([(found, query, retailer)], "c array<double>, q string, r string")
    assert row.select(prices.best_price(F.col("c"), F.col("q"), F.col("r")).alias("x")).first()["x"] == best


def test_resolve_price(spark):
    rows = [
        ("DJI Osmo Pocket 3", "walmart", None, None, "product_not_found", [419.0, 429.0], None),
        ("camera", "target", None, None, "timeout", [419.0], None),
        ("camera", "target", 50.0, 60.0, None, [419.0], None),
        ("camera", "target", None, 60.004, None, [419.0], None),
        ("camera", "target", None, 3.0, None, [], 77.0),
        ("camera", "target", None, None, None, [], None),
    ]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, query string, retailer_key string, listing_price double, reply_price double, reply_error string, candidates array<double>, page_price double")
    out = [(r["price"], r["price_source"], r["error"]) for r in listings.resolve_price(table).orderBy("i").collect()]
    assert out == [(419.0, "regex", None), (None, None, "timeout"), (50.0, "llm", None), (60.0, "llm", None), (77.0, "html_extract", None), (None, None, None)]


def test_missing_price(spark):
    rows = [("ok", None, None, True), ("ok", "1", "product_not_found", True), ("ok", "419", None, False), ("blocked", None, None, False), ("ok", "x", None, True)]
    for status, price, error, want in rows:
        assert one(spark, listings.missing_price(F.col("s"), F.col("p"), F.col("e")), s=status, p=price, e=error) is want


def test_aggregator(spark):
    page = "DJI Osmo Pocket 3\nWalmart\n$419.00\nFree delivery\nAmazon\n$429.00"
    rows = spark.createDataFrame([(1, page, "", "DJI Osmo Pocket 3"), (2, "nothing", None, "x")], "page_id int, page_text string, html string, query string")
    found = {r["retailer_key"]: r for r in listings.aggregator_listings(rows).collect()}
    assert found["walmart"]["price"] == 419.0 and found["amazon"]["price"] == 429.0
    assert found["walmart"]["price_source"] == "regex_text" and set(found) == {"walmart", "amazon"}


def test_aggregator_json_and_labels(spark):
    html = '{"merchant":"Best Buy","x":1,"price":"$355.00"} <a aria-label="Target offer $399.99 today">'
    rows = spark.createDataFrame([(1, "", html, "camera")], "page_id int, page_text string, html string, query string")
    found = {r["retailer_key"]: r["price"] for r in listings.aggregator_listings(rows).collect()}
    assert found["bestbuy"] == 355.0 and found["target"] == 355.0  # one line holds both, the least counts
    split = rows.withColumn("html", F.replace("html", F.lit(" <a"), F.lit("\n\n\n\n<a")))
    assert {r["retailer_key"]: r["price"] for r in listings.aggregator_listings(split).collect()}["target"] == 399.99


def test_listings_payload(spark):
    rows = [(1, 0, "lamp", "Desk Lamp", "49.99", None, "A", None), (1, 1, "lamp", "Desk Lamp Basic", "29.99", "39.99", "B", None), (1, 2, "lamp", "desk lamp", "49.99", None, "a", None), (1, 3, "lamp", ":root{}", "60", None, None, None)]
    table = spark.createDataFrame(rows, "payload_id int, pos int, query string, product_name string, price string, original_price string, seller string, product_url string")
    out = listings.rollup_listings(listings.dedupe_listings(listings.normalize_listings(table))).first()
    assert (out["n_products"], out["product_name"], out["price"], out["original_price"]) == (2, "Desk Lamp Basic", 29.99, 39.99)


def test_product_fields(spark):
    ld = lambda body: f'<script type="application/ld+json">{body}</script>'
    pages_ = [
        (1, ld('{"@graph":[{"@type":"Product","name":"G","brand":"B","offers":[{"price":"1,234.5"}],"image":["i.jpg"]}]}'), ""),
        (2, ld("not json") + ld('[{"@type":"Other"},{"@type":"Offer","name":"O"}]'), "Now $99.50"),
        (3, '<meta property="og:title" content=" Meta "><meta name="og:description" content="d">', ""),
        (4, "", "\n  First line\nNow $45"),
        (5, "", ""),
    ]
    table = spark.createDataFrame(pages_, "page_id int, html string, page_text string")
    out = {r["page_id"]: r for r in listings.product_fields(table).collect()}
    assert (out[1]["title"], out[1]["brand"], out[1]["price"], out[1]["image_url"], out[1]["availability"]) == ("G", "B", 1234.5, "i.jpg", "unknown")
    assert (out[2]["title"], out[2]["price"]) == ("O", 99.5)
    assert (out[3]["title"], out[3]["description"]) == ("Meta", "d")
    assert (out[4]["title"], out[4]["price"]) == ("First line", 45.0)
    assert out[5]["error"] == "parse_failed" and out[5]["title"] is None


# ---- text


def test_text_forms(spark):
    assert one(spark, text.strip_noise(F.col("h")), h="a<SCRIPT x>1\n2</script>b<style>c</style>") == "a b "
    assert one(spark, text.html_to_text(F.col("h"), "folded"), h="<p>a</p>\n <b>b</b>") == "a b"
    assert one(spark, text.page_title(F.col("h")), h="<title a='1'> T </title>") == "T"
    assert one(spark, text.clean_text(F.col("t")), t="\n\n a \n\n\n\n b\n") == "\na\n\nb"
    assert one(spark, text.sanitize_text(F.col("t")), t=":root{}\n--x: 1\n real content \n{}\n1 % 2") == "real content"
    assert one(spark, text.sanitize_text(F.col("t")), t="plain :root") == "plain :root"
    assert one(spark, text.fresh_seconds(F.col("u")), u="https://finance.yahoo.com/sec.gov") == 86400


def test_excerpt(spark):
    found = one(spark, text.price_excerpt(F.col("t"), F.col("h")), t="x" * 200 + " DJI Pocket $419.00 here", h="<b>nothing</b>")
    assert "$419.00" in found and len(found) < 260
    assert one(spark, text.price_excerpt(F.col("t"), F.col("h")), t="nothing here", h=None) == "nothing here"


def test_chunks(spark):
    def chunks_of(*texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r[0] for r in rows.select(text.chunks(F.col("t")), "i").orderBy("i").collect()]

    rng = random.Random(1)
    assert chunks_of("short", None, "") == [["short"], [""], [""]]
    many = ["\n\n".join("".join(rng.choice("ab ") for _ in range(rng.choice([10, 3000, 9000, 30_000]))) for _ in range(n)) for n in range(2, 20)]
    for whole, found in zip(many, chunks_of(*many), strict=True):
        assert all(len(c) <= text.CHUNK + text.OVERLAP + 2 for c in found)
        joined = "".join(found)
        assert all(p.strip()[:50] in joined for p in whole.split("\n\n") if p.strip())
    long, two = "x" * 25_000, "a" * 8000 + "\n\n" + "b" * 8000
    three = "a" * 7000 + "\n\n\n" + "b" * 4998 + "\n\nc"
    found = chunks_of(long, two, three, " \n\n" + long + "\n\n \n\nend")
    assert [len(c) for c in found[0]] == [12_000, 12_000, 2600]
    assert found[1] == ["a" * 8000, "a" * 800 + "\n\n" + "b" * 8000]
    assert found[2] == ["a" * 7000 + "\n\n" + "b" * 4998, "b" * 800 + "\n\nc"]
    assert [len(c) for c in found[3]] == [12_000, 12_000, 2600, 3]


def test_context(spark):
    rows = spark.createDataFrame([("Camera\n\n" + "z " * 30_000 + "\n\nNow $419.00 price USD buy", "<p class='price'>", "camera", "walmart")], "page_text string, html string, query string, retailer_key string")
    out = pages.build_llm_context(rows).first()
    assert out["candidates"] == [419.0] and out["context"].startswith("Pre-detected USD price candidates on this page: $419.00\n") and len(out["context"]) <= 52_000
    assert "Now $419.00" in out["context"]


# ---- replies


def test_parse_replies(spark):
    raw = ['```json\n{"a": 1,}\n```', "[1, 2]", 'text {"price": 3} tail', '{"product_name": "x\\"y", "price": 12.5, "seller": "cut', "nothing", None]
    table = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, reply string")
    out = [(r["how"], r["parsed"]) for r in replies.parse_replies(table).orderBy("i").collect()]
    assert [h for h, _ in out] == ["direct", "wrapped", "inner", "salvaged", "failed", "failed"]
    assert json.loads(out[1][1]) == {"result": [1, 2]} and json.loads(out[3][1])["product_name"] == 'x"y'


def test_merge_replies(spark):
    def merged(*parts):
        rows = spark.createDataFrame([(1, i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(parts)], "page_id int, panel int, parsed string")
        return json.loads(replies.merge_partials(rows).first()["merged"])

    parts = [{"price": None, "_raw": 1, "tags": [1], "h": {"a": 1, "b": None}}, {"_error": "x", "price": 1}, {"price": 47.41, "tags": [1, 2], "h": {"a": 2, "b": 3}}]
    assert merged(*parts) == {"price": 47.41, "tags": [1, 2], "h": {"a": 1, "b": 3}}
    assert merged({"a": {"b": {"c": 1, "d": [1]}}}, {"a": {"b": {"c": 2, "d": [2, 1], "e": "x\"y"}}}, {"a": 5}) == {"a": {"b": {"c": 1, "d": [1, 2], "e": 'x"y'}}}
    assert merged({"a": 1, "l": [{"x": 1, "y": 2}, "1"]}, {"a": {"b": 1}, "l": [1, {"y": 2, "x": 1}]}, "[1]", "broken {") == {"a": 1, "l": [{"x": 1, "y": 2}, "1"]}
    assert merged({"a": {"_x": 1, "n": None}}) == {"a": {"_x": 1, "n": None}} and merged({"_error": "x"}) == {} and merged({"a": {"_x": 1}}, {"a": {"_y": 2}}) == {"a": {}}


def test_merge_partials_takes_panels_in_order(spark):
    rows = spark.createDataFrame([(1, 2, '{"price": 2}'), (1, 1, '{"price": null, "x": [1]}'), (1, 3, '{"price": 3, "x": [1, 2]}')], "page_id int, panel int, parsed string")
    assert json.loads(replies.merge_partials(rows).first()["merged"]) == {"price": 2, "x": [1, 2]}


def test_flatten_and_signal(spark):
    reply = '{"quote_header": {"regularMarketPrice": 47.41, "n": null}, "news": [1], "_x": 1, "title": "T"}'
    rows = spark.createDataFrame([(1, reply)], "page_id int, parsed string")
    assert {(r["name"], r["value"]) for r in replies.flatten_reply(rows).collect()} == {("vision.quote_header.regularMarketPrice", "47.41"), ("vision.title", "T")}
    for parsed, want in (('{"price": 1}', True), ('{"products": [{}]}', True), ('{"price": 0, "products": []}', False)):
        assert one(spark, replies.has_signal(F.col("p")), p=parsed) is want


def test_reply_to_shop(spark):
    two = '{"products": [{"product_name": "B", "price": "$539"}, {"title": "A", "price": 419}]}'
    rows = spark.createDataFrame([(1, "laptop", '{"product_name": "Laptop", "price": 899}'), (2, "camera", two)], "payload_id int, query string, parsed string")
    out = {r["payload_id"]: r for r in replies.reply_to_shop(rows).collect()}
    assert (out[1]["price"], out[1]["price_source"]) == (899.0, "vision") and (out[2]["product_name"], out[2]["price"], out[2]["n_products"]) == ("A", 419.0, 2)


# ---- catalog


def test_normalize_products(spark):
    rows = [("AirPods Pro", "Apple", "MTJV3"), ("  Big   Sale  TV ", "o'neil hp-inc", None), ("", None, None)]
    out = catalog.normalize_products(spark.createDataFrame(rows, "title string, brand string, mpn string")).collect()
    assert out[0]["normalized_key"] == "apple|airpods pro|mtjv3"
    assert (out[1]["canonical_title"], out[1]["brand"]) == ("Big  TV", "O'Neil Hp-Inc")
    assert out[2]["normalized_key"] is None


def test_match_cascade(spark):
    products = spark.createDataFrame([(1, "Thing One", "acme", "m1", "g1", "k1"), (2, "Thing Two", "acme", "m2", None, "k2")], "product_id int, canonical_title string, brand string, mpn string, gtin string, normalized_key string")
    rows = [(1, "x", "other", None, None, "g1", None), (2, "x", "ACME", None, "m2", None, None), (3, "x", None, None, None, None, "k2"), (4, "x", None, None, None, None, None)]
    incoming = spark.createDataFrame(rows, "in_id int, canonical_title string, brand string, mpn string, model_number string, gtin string, normalized_key string")
    out = {r["in_id"]: (r["product_id"], r["match_type"]) for r in catalog.match_exact(incoming, products).collect()}
    assert out == {1: (1, "gtin_exact"), 2: (2, "mpn_brand"), 3: (2, "normalized_key"), 4: (None, None)}


def similar(a, b):
    """The ratio, or 0 where one of difflib's own upper bounds shows that it is under 0.8."""
    from difflib import SequenceMatcher

    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 else 0.0


def plain_fuzzy(asked, products):
    """in_id -> (product_id, ratio) by comparing every title with every other."""
    want = {}
    for i, title, brand in asked:
        best = (0.0, None)
        for k, name, theirs in products:
            if not title or not name or (brand and theirs and brand.lower() != theirs.lower()):
                continue
            ratio = similar(title.lower(), name.lower())
            if ratio >= 0.8 and (ratio > best[0] or ratio == best[0] and k < best[1]):
                best = (ratio, k)
        if best[0]:
            want[i] = best[::-1]
    return want


def found_fuzzy(spark, asked, products, block):
    rows = spark.createDataFrame(asked, "in_id int, canonical_title string, brand string"), spark.createDataFrame(products, "product_id string, canonical_title string, brand string")
    out = catalog.match_fuzzy(*rows, block).collect()
    assert all(r["needs_review"] == (r["confidence"] < 0.92) and r["match_type"] == "fuzzy_title" for r in out) and len({r["in_id"] for r in out}) == len(out)
    return {r["in_id"]: (r["product_id"], r["confidence"]) for r in out}


@pytest.mark.parametrize("block", [2, 1024])
def test_fuzzy_titles(spark, block):
    """Joined words, long titles, other alphabets, ties, missing brands and titles."""
    names = ["blue widget large", "blue widget large x", "red gadget", "red gadgets set", "tiny ring", "blue gadget", "iphone15promax256gb", "", None, "Ünïcode lämp 😀", "x" * 90 + " wide banner of the shop " * 4, "tiny ring"]
    products = [(f"p{i:02}", n, "b" if i % 2 else None) for i, n in enumerate(names)]
    asked = [
        (10, "Blue Widget large", None), (11, "red gadgets", "c"), (12, "nothing alike", None), (13, "tiny ring", "B"), (14, "iphone15 promax 256gb", ""), (15, None, "b"), (16, "", None),
        (17, "ünicode lämp 😀", "b"), (18, "x" * 88 + " wide banner of a shop " * 4, None), (19, "tiny rings", None), (13, "tiny ring", "B"),
    ]
    found = found_fuzzy(spark, asked[:-1], products, block)
    assert found == plain_fuzzy(asked, products) and {10, 13, 14, 17, 18, 19} <= set(found)
    assert found_fuzzy(spark, [], products, block) == found_fuzzy(spark, asked, [], block) == {}


def test_fuzzy_titles_of_a_whole_catalog(spark):
    """2,000 titles of few, frequent words, some joined, some with typing errors: all pairs compared."""
    import random

    rng = random.Random(4)
    words = "pro max ultra phone case cover black white silver 64gb 128gb 256gb wireless charger usb cable red lamp desk osmo pocket".split()
    title = lambda: rng.choice([" ", " ", ""]).join(rng.choice(words) for _ in range(rng.randint(2, 9)))
    brand = lambda: rng.choice(["acme", "Acme", "bolt", "", None])
    products = [(f"p{rng.randint(0, 9999):04}-{i}", title(), brand()) for i in range(1600)]
    spoilt = lambda t: t[: (k := rng.randrange(len(t)))] + rng.choice(["", "x", " "]) + t[k + rng.choice([0, 1]) :]
    asked = [(i, title() if i % 4 == 0 else spoilt(spoilt(rng.choice(products)[1])), brand()) for i in range(400)]
    found = found_fuzzy(spark, asked, products, 100)
    assert found == plain_fuzzy(asked, products) and len(found) > 200


def test_ticker_urls(spark):
    tickers = spark.createDataFrame([(f"T{i}", 60 - i) for i in range(60)] + [("A.B", -1)], "ticker string, pos int")
    templates = spark.createDataFrame([("x/{ticker}?q={ticker}",), ("y",)], "template string")
    found = [tuple(r) for r in catalog.expand_ticker_urls(tickers, templates).collect()]
    first = ["A.B", *[f"T{i}" for i in range(59, 10, -1)]]
    assert sorted(found) == sorted([(t, f"x/{t}?q={t}") for t in first] + [(t, "y") for t in first])
    assert {r[0] for r in catalog.expand_ticker_urls(tickers, templates, 2).collect()} == {"A.B", "T59"}


def test_upsert_keeps_what_it_must(spark):
    offers = spark.createDataFrame([(1, "T", 5, 10.0, "in_stock", 4.0, 3, "u", datetime(2024, 1, 1)), (1, "Old", 6, 1.0, "x", None, None, None, datetime(2024, 1, 1))], "source_id int, title string, product_id int, price double, availability string, rating double, review_count int, url string, last_seen_at timestamp")
    seen = [(1, "T", 5, 12.0, "gone", 1.0, 9, None, datetime(2024, 2, 2), 2), (1, "T", 5, 11.0, "gone", 1.0, 9, "v", datetime(2024, 2, 1), 1), (2, None, 7, None, "new", 2.0, 1, "w", datetime(2024, 2, 1), 1)]
    incoming = spark.createDataFrame(seen, "source_id int, title string, product_id int, price double, availability string, rating double, review_count int, url string, observed_at timestamp, seq int")
    out = {(r["source_id"], r["title"]): r for r in catalog.upsert_offers(offers, incoming, "2024-03-01").collect()}
    t = out[1, "T"]
    assert (t["price"], t["availability"], t["review_count"], t["url"], t["last_seen_at"]) == (12.0, "in_stock", 3, "u", datetime(2024, 3, 1))
    assert out[2, "Unknown"]["availability"] == "new" and out[1, "Old"]["last_seen_at"] == datetime(2024, 1, 1)


# ---- ranking


def test_scores(spark):
    now = datetime(2024, 6, 1)
    rows = [(1, 50.0, "in_stock", now, None, None), (2, 100.0, "in_stock", now, None, None), (3, 50.0, "out_of_stock", now, None, None), (4, 50.0, "in_stock", now - timedelta(days=40), None, None), (5, None, None, None, 5.0, 50)]
    table = spark.createDataFrame(rows, "offer_id int, price double, availability string, last_seen_at timestamp, rating double, review_count int").withColumn("shipping_price", F.lit(None).cast("double")).withColumn("g", F.lit(1))
    ranked = ranking.rank_offers(ranking.score_offers(table, ["g"], "2024-06-01"), ["g"]).collect()
    score = {r["offer_id"]: r["shopping_score"] for r in ranked}
    assert score[1] > score[2] and score[1] > score[3] and score[1] > score[4] and all(0 <= s <= 1 for s in score.values())
    assert score[1] == pytest.approx(0.3 + 0.2 + 0.14 + 0.075 + 0.1 + 0.025) and score[5] == pytest.approx(0.21 + 0.08 + 0.14 + 0.15 + 0.01 + 0.025)
    assert ranked[0]["offer_id"] == 1


# ---- compliance


@pytest.mark.parametrize(("kind", "status", "want"), [("api", "active", "ok"), ("api", "paused", "source_status_paused"), ("api", "pending_review", "source_not_active"), ("google_shopping", "active", "google_shopping_direct_scrape_rejected"), ("api", None, "source_not_active")])
def test_gate(spark, kind, status, want):
    assert one(spark, compliance.source_gate(F.col("k"), F.col("s"))[1], k=kind, s=status) == want


def test_blocks(spark):
    rows = [("please solve the captcha", 200, 1), ("please solve the captcha", 200, 4), ("fine", 403, 2), ("fine", 429, 1), ("x" * 20_000 + "sign in", 200, 1)]
    table = spark.createDataFrame(rows, "t string, s int, tier int").withColumn("r", compliance.classify_block(F.col("t"), F.col("s"), F.lit("u")))
    escalate, stop = compliance.escalation_decision(F.col("r"), F.col("tier"))
    assert [tuple(r) for r in table.select("r", escalate, stop).collect()] == [("captcha_detected", True, False), ("captcha_detected", False, True), ("access_denied", False, False), ("rate_limited", True, False), ("ok", False, False)]


@pytest.mark.parametrize(("html", "want"), [("<div id='px-captcha'>", "perimeterx"), ("geo.captcha-delivery.com", "datadome"), ("<div class=g-recaptcha>", "recaptcha"), ("just a moment", "cloudflare"), ("fine", None)])
def test_vendor(spark, html, want):
    assert one(spark, compliance.wall_vendor(F.col("h"), F.lit(""), F.lit(None).cast("string")), h=html) == want


def test_usable(spark):
    rows = [("amazon", "ok", '<div class="s-search-result">', None), ("amazon", "blocked", '<div class="s-search-result">', None), ("amazon", "ok", "<p>", "curl"), ("unknown", "ok", "<p>", None), ("amazon", "ok", "<p>", "browser_grid")]
    table = spark.createDataFrame(rows, "retailer_key string, status string, html string, fetch_backend string").withColumns({"text": F.lit(""), "title": F.lit("t"), "char_count": F.lit(10), "i": F.monotonically_increasing_id()})
    out = compliance.usable_pages(table, compliance.profiles(spark)).orderBy("i").collect()
    assert [r["usable"] for r in out] == [True, False, False, True, True]


def test_likely_blocked(spark):
    call = lambda **v: one(spark, compliance.likely_blocked(F.col("u"), F.col("t"), F.col("x"), F.col("c"), F.col("r")), **v)
    assert call(u="https://a/blocked", t="", x="", c=50_000, r="") and not call(u="https://a", t="", x="fine", c=50_000, r="walmart")
    assert call(u="", t="", x="fine", c=100, r="walmart") and not call(u="", t="", x="fine", c=100, r=None)


def plain_admission(times, delay, limit):
    accepted, out, clock = [], [], None
    for t in times:
        now = max(t, clock) if clock is not None else t
        if accepted and now - accepted[-1] < delay:
            now = accepted[-1] + delay
        clock = now
        if sum(a >= now - 60 for a in accepted) >= limit:
            out.append(None)
        else:
            accepted.append(now)
            out.append(now)
    return out


def test_admission(spark):
    rng = random.Random(3)
    for delay, limit in ((10.0, 6), (1.0, 3), (30.0, 6)):
        times = sorted(rng.uniform(0, 300) for _ in range(60))
        assert helpers.admit(times, [delay] * 60, [limit] * 60)[0] == plain_admission(times, delay, limit)
        first, *state = helpers.admit(times[:30], [delay] * 30, [limit] * 30)
        assert first == plain_admission(times, delay, limit)[:30]
        assert helpers.admit(times[30:], [delay] * 30, [limit] * 30, *state)[0] == plain_admission(times, delay, limit)[30:]
    rows = [("h", i, float(t), 1.0, 3) for i, t in enumerate(times)]
    out = compliance.admit_requests(spark.createDataFrame(rows, "domain string, request_id long, requested_at double, delay double, max_rpm int")).orderBy("request_id").collect()
    assert [r["started_at"] for r in out] == plain_admission(times, 1.0, 3)


def test_robots(spark):
    rules = "User-agent: *\nDisallow: /search\n"
    urls = spark.createDataFrame([("https://a.com/search?q=1",), ("https://a.com/p",), ("https://b.com/p",)], "url string")
    table = spark.createDataFrame([("https://a.com", rules)], "host_key string, rules string")
    out = {r["url"]: r["reason"] for r in compliance.robots_gate(urls, table, "bot").collect()}
    assert out == {"https://a.com/search?q=1": "disallowed_by_robots", "https://a.com/p": "allowed_by_robots", "https://b.com/p": "robots_unavailable"}
    texts = [
        rules, "# all\nUser-agent: other\nUser-agent: BOT\nAllow: /a/b\nDisallow: /a # no\n\nUser-agent: *\nDisallow: /\n", "Disallow: /x\nUser-agent: *\nDisallow:\n",
        "User-agent: nobody\nDisallow: /\n", "User-agent: *\nAllow: /p\nDisallow: /\n", "",
    ]
    paths = ["", "/", "/search?q=1", "/a/b/c", "/a/c", "/p", "/x"]
    urls = spark.createDataFrame([(f"https://h{i}.com{p}",) for i in range(len(texts)) for p in paths], "url string")
    table = spark.createDataFrame([(f"https://h{i}.com", t) for i, t in enumerate(texts)], "host_key string, rules string")
    out = {r["url"]: r["allowed"] for r in compliance.robots_gate(urls, table, "bot/1.0").collect()}
    for i, t in enumerate(texts):
        parser = RobotFileParser()
        parser.parse(t.splitlines())
        assert [out[f"https://h{i}.com{p}"] for p in paths] == [parser.can_fetch("bot/1.0", f"https://h{i}.com{p}") for p in paths], t


# ---- metrics


def test_circuit(spark):
    rows = [("a", i, False, "customer_suspended" if i == 0 else "x") for i in range(1)] + [("b", i, False, "captcha_detected") for i in range(5)] + [("c", i, False, "boom") for i in range(5)] + [("d", i, i == 3, "boom") for i in range(5)]
    out = {r["provider"]: (r["failures"], r["disabled_reason"], r["is_open"]) for r in metrics.circuit_state(spark.createDataFrame(rows, "provider string, seq int, ok boolean, error string")).collect()}
    assert out == {"a": (1, "suspended_or_billing", True), "b": (0, None, False), "c": (5, None, True), "d": (1, None, False)}


# ---- finance


@pytest.mark.parametrize(("url", "want"), [("https://finance.yahoo.com/quote/HPE/", "HPE"), ("https://finance.yahoo.com/quote/aapl/key-statistics", "AAPL"), ("https://x.com/quote/A", None)])
def test_ticker(spark, url, want):
    assert one(spark, finance.quote_ticker(F.col("u")), u=url) == want


def test_modules(spark):
    tree = {"price": {"regularMarketPrice": {"raw": 47.41, "fmt": "47.41"}, "shortName": "HPE", "x": None, "e": {}}, "summaryDetail": {"marketCap": {"raw": 62e9, "fmt": "62B", "longFmt": "62,000"}}, "l": {"none": [], "rows": [{"a": {"raw": 1}, "b": 2}, {"c": 3}], "mixed": [1, {"a": 1}]}, "skip": 1}
    rows = spark.createDataFrame([("HPE", json.dumps(tree)), ("BAD", "{")], "ticker string, modules string")
    out = {r["key"]: json.loads(r["value_json"]) for r in finance.flatten_modules(rows).collect()}
    assert out == {"price.regularMarketPrice": 47.41, "price.shortName": "HPE", "summaryDetail.marketCap": 62e9, "l.none": [], "l.rows": [{"a": 1}, {"c": 3}], "l.mixed": [1, {"a": 1}]}


def quote_rows(spark, html, symbol="HPE"):
    return spark.createDataFrame([(1, html, symbol)], "page_id int, html string, symbol string")


def test_scoped_quote(spark):
    html = '{"symbol":"BTC-USD","regularMarketPrice":{"raw":64000}}' + " " * 4100 + '{"symbol":"HPE","regularMarketPrice":{"raw":47.41,"fmt":"47"},"shortName":"HP"}'
    out = {r["name"]: r["value"] for r in finance.scoped_quote_fields(quote_rows(spark, html)).collect()}
    assert out == {"regularMarketPrice": "47.41", "shortName": "HP"}
    assert finance.regular_price(quote_rows(spark, html)).first()["price"] == 47.41


def test_streamers(spark):
    html = '<fin-streamer data-symbol="HPE" data-field="regularMarketPrice" value="47.41"></fin-streamer><fin-streamer data-field="marketCap" value="62,000" data-symbol="HPE"></fin-streamer><fin-streamer data-symbol="HPE" data-field="regularMarketPrice" value="1">'
    assert {r["name"]: r["value"] for r in finance.streamer_fields(quote_rows(spark, html)).collect()} == {"regularMarketPrice": "47.41", "marketCap": "62000.0"}
    assert {r["name"]: r["value"] for r in finance.scoped_quote_fields(quote_rows(spark, html)).collect()}["regularMarketPrice"] == "1.0"


def test_scoped_numbers_are_told_as_python_tells_them(spark):
    said = {"marketCap": "10000000", "trailingPE": "0.0001234", "forwardPE": "12345678.5", "regularMarketVolume": "123456789012345678901"}
    html = '{"symbol":"HPE",' + ",".join(f'"{k}":{v}' for k, v in said.items()) + '}<fin-streamer data-symbol="HPE" data-field="regularMarketOpen" value="1,2100000">'
    out = {r["name"]: r["value"] for r in finance.scoped_quote_fields(quote_rows(spark, html)).collect()}
    assert out == {k: str(float(v)) for k, v in said.items()} | {"regularMarketOpen": "12100000.0"}
    pages = quote_rows(spark, '<b data-test="qsp-price">12,345,678.5</b>').withColumn("candidates", F.array(F.lit(1e7)))
    assert {r["name"]: r["value"] for r in finance.page_quote_fields(pages).collect()} == {"asp.regularMarketPrice": "12345678.5", "asp.price_candidate_0": "10000000.0"}


def test_double_text(spark):
    from pricetide.functions.numbers import double_text

    rng = random.Random(5)
    values = [0.0, -0.0, 1.0, -12100000.0, 1e7, 9999999.0, 1e15, 1e16, 9999999999999998.0, 0.001, 0.0001, 0.00012345, 1e-5, 2e23, 1.5e100, -1.5e-100, 2.0**-44, 2.0**-25, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan"), None]
    values += [rng.random() * 10.0 ** rng.randint(-7, 17) for _ in range(500)] + [round(rng.random() * 10.0 ** rng.randint(0, 12), rng.randint(0, 6)) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", double_text(F.col("x"))).collect()
    assert [t for _, t in sorted(map(tuple, rows), key=lambda r: r[0])] == [None if v is None else repr(v) for v in values]


def test_large_streamer_numbers_are_told_as_python_tells_them(spark):
    said = {"regularMarketVolume": "12,100,000", "marketCap": "$1234567890123.5", "ratio": "1e-3", "tiny": "1e-7", "far": "1e16", "name": " 12 parts "}
    html = "".join(f'<fin-streamer data-symbol="HPE" data-field="{k}" value="{v}">' for k, v in said.items())
    want = {"regularMarketVolume": "12100000.0", "marketCap": "1234567890123.5", "ratio": "0.001", "tiny": "1e-07", "far": "1e+16", "name": "12 parts"}
    assert {r["name"]: r["value"] for r in finance.streamer_fields(quote_rows(spark, html)).collect()} == want


def test_bare_prices(spark):
    assert one(spark, finance.page_price(F.col("h")), h='{"regularMarketPrice":{"raw":198.42}}') == 198.42
    assert one(spark, finance.page_price(F.col("h")), h='"regularMarketPrice":201.5,') == 201.5
    assert one(spark, finance.page_price(F.col("h")), h='"regularMarketPrice":0, "currentPrice":{"raw":5}') is None


def test_vision_price_wins(spark):
    rows = [("HPE", "asp.regularMarketPrice", "46.0", 1), ("HPE", "vision.regularMarketPrice", "47.41", 2), ("HPE", "vision.news.0", "x", 2), ("HPE", "html.regularMarketPrice", "47.41", 1), ("IBM", "asp.regularMarketPrice", "1", 1)]
    out = {(r["ticker"], r["name"]) for r in finance.merge_quote_sources(spark.createDataFrame(rows, "ticker string, name string, value string, prio int")).collect()}
    assert out == {("HPE", "vision.regularMarketPrice"), ("HPE", "html.regularMarketPrice"), ("IBM", "asp.regularMarketPrice")}


def test_headlines(spark):
    rows = spark.createDataFrame([(1, '<a href="/news/1"><h3>Apple beats estimates on services growth</h3></a><h3>Another headline here</h3>'), (2, "<h3>Only bare headline</h3><h3>short</h3><h3>Only bare headline</h3>")], "page_id int, html string")
    out = {(r["page_id"], r["pos"], r["title"], r["link"]) for r in finance.html_articles(rows).collect()}
    assert out == {(1, 0, "Apple beats estimates on services growth", "/news/1"), (2, 0, "Only bare headline", "")}


# ---- values that a text-based rounding, or a missing column, gets wrong


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_goes_by_the_exact_value(spark, digits):
    from pricetide.functions.numbers import rounded

    rng = random.Random(5)
    values = [32.675, 2.675, 1.005, 0.125, 6.25, 100 / 16, 1 / 8, 0.0, -32.675, -0.125, 1e15 + 0.5, 1e300, 44999.995]
    values += [round(rng.uniform(0, 50_000), digits) + 5 * 10.0 ** -(digits + 1) for _ in range(3000)] + [rng.uniform(-1e6, 1e6) for _ in range(1000)]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["x"] for r in table.select(rounded(F.col("v"), digits).alias("x")).collect()] == [round(v, digits) for v in values]


def test_listing_aliases(spark):
    rows = [("p", 0, "lamp", None, "Desk lamp", None, "49.99", None, "$60", None, "u1"), ("p", 1, "lamp", "", None, "Floor lamp", "30", "20", None, "u2", None), ("p", 2, "lamp", None, None, None, "30", None, None, None, None)]
    table = spark.createDataFrame(rows, "payload_id string, pos int, query string, product_name string, title string, name string, price string, original_price string, list_price string, product_url string, url string")
    out = [(r["product_name"], r["price"], r["original_price"], r["product_url"]) for r in listings.normalize_listings(table).orderBy("pos").collect()]
    assert out == [("Desk lamp", 49.99, 60.0, "u1"), ("Floor lamp", 30.0, None, "u2")]
    named = catalog.normalize_products(spark.createDataFrame([(None, "Sale Lamp", None, None)], "title string, product_name string, brand string, mpn string"))
    assert named.first()["canonical_title"] == "Lamp"


def test_upsert_keeps_all_columns(spark):
    stored = spark.createDataFrame([("o1", "s", "Lamp", "Shop", "EUR", 5.0, "img", "u", 4.0, "in_stock", datetime(2024, 1, 1))], "offer_id string, source_id string, title string, merchant_name string, currency string, price double, image_url string, url string, rating double, availability string, last_seen_at timestamp")
    rows = [("s", "Lamp", 7.0, None, "u9", 1.0, "out_of_stock"), ("s", "", None, None, "u2", 0.0, "unknown"), ("t", "Lamp", 3.0, "v", "u3", 2.5, None)]
    incoming = spark.createDataFrame(rows, "source_id string, title string, price double, url string, page_url string, rating double, availability string").withColumns({"observed_at": F.lit("2024-02-01").cast("timestamp"), "seq": F.lit(1)})
    out = catalog.upsert_offers(stored, incoming, "2024-02-02")
    assert out.columns == stored.columns
    found = {(r["source_id"], r["title"]): r for r in out.collect()}
    old, blank, new = found["s", "Lamp"], found["s", "Unknown"], found["t", "Lamp"]
    assert (old["offer_id"], old["merchant_name"], old["currency"], old["price"], old["url"], old["rating"], old["availability"], old["image_url"]) == ("o1", "Shop", "EUR", 7.0, "u", 4.0, "in_stock", "img")
    assert (blank["price"], blank["url"], blank["rating"], blank["currency"]) == (None, "u2", None, "USD") and len(blank["offer_id"]) == 64
    assert (new["price"], new["url"], new["rating"], str(new["last_seen_at"])) == (3.0, "v", 2.5, "2024-02-02 00:00:00") and new["offer_id"] != blank["offer_id"]


def test_fresh_fetches_break_ties(spark):
    at = datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([("u", at, i) for i in (3, 9, 4)], "url string, fetched_at timestamp, seq int")
    assert [r["seq"] for r in pages.fresh_fetches(rows, "2024-01-01 12:00:30").collect()] == [9]


def test_spend_over_budget_opens_paid_circuits(spark):
    log = spark.createDataFrame([("brightdata_unlocker", i, True, None) for i in range(3)] + [("js_browser", 9, True, None)], "provider string, seq int, ok boolean, error string")
    for last, want in ((True, "daily_budget_exceeded"), (False, None)):
        spend = spark.createDataFrame([("2024-01-01", not last), ("2024-01-02", last)], "day string, over_budget boolean")
        out = {r["provider"]: r["disabled_reason"] for r in metrics.circuit_state(log, spend=spend).collect()}
        assert out == {"brightdata_unlocker": want, "js_browser": None}
