"""The workloads end to end on a few rows."""

from __future__ import annotations

import hashlib
from datetime import datetime
from itertools import groupby

from pricetide.plans import quotes, shopping
from pricetide.sources.tables import load
from pricetide.sources import envelopes

SF = "/root/testdata/sf0.001"


def test_pages_and_replies_resolve(spark):
    page = '<div data-automation-id="product-price">$419.00</div>'
    pages = spark.createDataFrame([(1, "u1", page, "", "camera", "walmart"), (2, "u2", page, "", "camera", "walmart"), (3, "u3", "<p>", "", "camera", "target"), (4, "u4", page, "", "camera", "walmart")], "page_id int, url string, html string, page_text string, query string, retailer_key string")
    said = spark.createDataFrame([(1, "camera", '{"product_name": "C", "price": 399}'), (2, "camera", '{"price": null, "_error": "product_not_found"}'), (3, "camera", "no json")], "page_id int, query string, reply string")
    out = {r["page_id"]: (r["price"], r["price_source"], r["error"]) for r in shopping.resolve_offers(pages, said).collect()}
    assert out == {1: (399.0, "llm", None), 2: (419.0, "regex", None), 3: (None, None, "json_parse_failed"), 4: (419.0, "regex", None)}


def test_every_incoming_row_has_at_most_one_match(spark):
    incoming, products = load(spark, SF, "incoming"), load(spark, SF, "products")
    found = shopping.match_products(incoming, products)
    assert found.count() == found.select("in_id").distinct().count()
    kinds = {r["match_type"] for r in found.select("match_type").distinct().collect()}
    assert {"gtin_exact", "mpn_brand", "normalized_key"} <= kinds <= {"gtin_exact", "mpn_brand", "normalized_key", "fuzzy_title", "new_product"}


def test_rows_of_one_new_product_share_it(spark):
    incoming = spark.createDataFrame([(i, "Quite new thing", None, None, None, None, "new|thing") for i in (4, 2, 9)], "in_id int, canonical_title string, brand string, mpn string, model_number string, gtin string, normalized_key string")
    products = spark.createDataFrame([("p1", "Osmo", None, None, None, "osmo")], "product_id string, canonical_title string, brand string, mpn string, gtin string, normalized_key string")
    found = {r["in_id"]: r for r in shopping.match_products(incoming, products).collect()}
    assert {i: r["match_type"] for i, r in found.items()} == {2: "new_product", 4: "normalized_key", 9: "normalized_key"}
    assert len({r["product_id"] for r in found.values()}) == 1


def test_best_offers(spark):
    out = shopping.ranked_offers(load(spark, SF, "offers"), "2001-12-01", 2)
    assert out.groupBy("product_id").count().where("count > 2").isEmpty() and not out.isEmpty()


def test_quotes(spark):
    modules = spark.createDataFrame([("HPE", '{"price": {"shortName": "HP", "regularMarketPrice": {"raw": 0}}}')], "ticker string, modules string")
    html = '<fin-streamer data-symbol="HPE" data-field="regularMarketPrice" value="46.5"><fin-streamer data-symbol="HPE" data-field="marketCap" value="62,000">'
    pages = spark.createDataFrame([("HPE", html, "HPE")], "page_id string, html string, symbol string")
    said = spark.createDataFrame([("HPE", '{"quote_header": {"regularMarketPrice": 47.41}, "news": []}')], "ticker string, parsed string")
    row = quotes.smart_quotes(modules, pages, said).first()
    assert (row["regularMarketPrice"], row["marketCap"], row["shortName"]) == (47.41, 62000.0, "HP")


def test_snapshots_are_appended_by_day(spark, tmp_path):
    pages = spark.createDataFrame([("u", "<title>T</title><p>x</p>")], "url string, html string")
    rows = envelopes.build_snapshots(envelopes.to_envelope(pages), "2024-01-02")
    for _ in range(2):
        envelopes.write_snapshots(rows, str(tmp_path / "s"))
    back = envelopes.read_pages(spark, str(tmp_path / "s"))
    assert back.count() == 2 and {str(r["fetch_date"]) for r in back.collect()} == {"2024-01-02"}


def test_snapshots_of_long_pages_hash_the_whole_page(spark, tmp_path):
    from hashlib import sha256

    from pricetide.queries import QUERIES

    html = {"u": "<p>" + "x" * 600_000 + "a", "v": "<p>" + "x" * 600_000 + "b", "w": "<p>short"}
    spark.createDataFrame(list(html.items()), "url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = {r["url"]: r for r in QUERIES["snapshots"](spark, str(tmp_path)).collect()}
    for url, text in html.items():
        assert (rows[url]["content_hash"], rows[url]["kept"], rows[url]["content_chars"]) == (sha256(text.encode()).hexdigest(), min(len(text), 500_000), len(text))


def test_pages_to_offers(spark):
    """Gated, walled and failed pages drop out; replies of a page merge; a page prices itself where nothing else does; offers and history follow."""
    filler = "plain text of the page " * 200
    tag = '<div data-automation-id="product-price">$419.00</div>'
    own = '<script type="application/ld+json">{"@type":"Product","name":"Own lamp","offers":{"price":"55.50","availability":"InStock"}}</script>'
    rows = [
        (1, "u1", tag, "camera", "walmart", 1, "ok", 200, 1), (2, "u2", own, "lamp", "target", 1, "ok", 200, 1), (3, "u3", tag, "camera", "walmart", 2, "ok", 200, 1),
        (4, "u4", tag, "camera", "walmart", 1, "ok", 403, 4), (5, "u5", tag, "camera", "walmart", 1, "error", 200, 1), (6, "u6", "<p>", "camera", "walmart", 1, "ok", 200, 1),
    ]
    rows.append((7, "u7", "<p>no shop</p>", "camera", "walmart", 1, "ok", 200, 1))
    schema = "page_id int, url string, html string, query string, retailer_key string, source_id int, status string, http_status int, tier int"
    pages = spark.createDataFrame([(*r,) for r in rows], schema).selectExpr("*", f"if(page_id = 2, '', '{filler}') as page_text", "if(page_id in (2, 6), 'browser_grid', 'curl') as fetch_backend")
    said = spark.createDataFrame(
        [(1, "camera", 1, '{"product_name": null, "price": null, "rating": 4.0}'), (1, "camera", 2, '{"product_name": "Osmo", "price": 399, "rating": 5.0}'), (2, "lamp", 1, '{"_error": "product_not_found"}'), (6, "camera", 1, "broken")],
        "page_id int, query string, panel int, reply string",
    )
    sources = spark.createDataFrame([(1, "api", "active"), (2, "api", "paused")], "source_id int, source_type string, status string")
    products = spark.createDataFrame([("p1", "Osmo", None, None, None, "osmo")], "product_id string, canonical_title string, brand string, mpn string, gtin string, normalized_key string")
    offers = spark.createDataFrame([("o1", 1, "Osmo", "p1", 450.0, "in_stock", None, 3, "old", "2024-01-01", "USD")], "offer_id string, source_id int, title string, product_id string, price double, availability string, rating double, review_count int, url string, last_seen_at string, currency string")
    offers = offers.withColumn("last_seen_at", offers["last_seen_at"].cast("timestamp"))
    made = shopping.pages_to_offers(pages, said, sources, products, offers, "2024-02-02")
    results = {r["page_id"]: (r["product_name"], r["price"], r["price_source"], r["error"]) for r in made.results.collect()}
    assert results == {
        1: ("Osmo", 399.0, "llm", None), 2: ("Own lamp", 55.5, "html_extract", None), 3: (None, None, None, "source_status_paused"), 4: (None, None, None, "access_denied"),
        5: (None, None, None, "fetch_failed"), 6: (None, None, None, "json_parse_failed"), 7: (None, None, None, "no_product_markers"),
    }
    stored = {r["title"]: r for r in made.offers.collect()}
    assert (stored["Osmo"]["offer_id"], stored["Osmo"]["price"], stored["Osmo"]["url"]) == ("o1", 399.0, "old")
    assert (stored["Own lamp"]["price"], stored["Own lamp"]["availability"], stored["Own lamp"]["url"]) == (55.5, "in_stock", "u2")
    assert {r["canonical_title"] for r in made.products.collect()} == {"Own lamp"} and stored["Own lamp"]["product_id"] == made.products.first()["product_id"]
    assert sorted((r["offer_id"] == "o1", r["price"]) for r in made.history.collect()) == [(False, 55.5), (True, 399.0)]
    assert "Unknown" in stored and stored["Unknown"]["price"] is None


def test_products_are_known_by_what_page_and_reply_say(spark):
    """gtin of the page where its product is the one priced, brand and mpn of the reply; a page's gtin is not lent to another product."""
    ld = lambda name, more: f'<script type="application/ld+json">{{"@type":"Product","name":"{name}",{more}}}</script>'
    rows = [(1, ld("Lamp A", '"gtin13":"0012"')), (2, ld("Lamp B", '"brand":{"name":"acme"}')), (3, ld("Lamp C", '"gtin":"0012","mpn":"Z9"')), (4, ld("Desk", '"gtin":"0099","offers":{"price":"70"}'))]
    pages = spark.createDataFrame([(i, f"u{i}", h, "", "lamp", "other", 1, "ok", 200, 1) for i, h in rows], "page_id int, url string, html string, page_text string, query string, retailer_key string, source_id int, status string, http_status int, tier int")
    said = spark.createDataFrame([(1, "lamp", '{"product_name": "lamp a", "price": 40}'), (2, "lamp", '{"product_name": "Lamp B", "price": 41, "mpn": "m7"}'), (3, "lamp", '{"product_name": "Quite another thing", "price": 42}')], "page_id int, query string, reply string")
    products = spark.createDataFrame([("p1", "Something", None, None, "0012", None), ("p2", "Else", "ACME", "m7", None, None), ("p3", "Third", None, None, "0099", None)], "product_id string, canonical_title string, brand string, mpn string, gtin string, normalized_key string")
    sources = spark.createDataFrame([(1, "api", "active")], "source_id int, source_type string, status string")
    offers = spark.createDataFrame([], "offer_id string, source_id int, title string, product_id string, price double, last_seen_at timestamp")
    made = shopping.pages_to_offers(pages, said, sources, products, offers, "2024-02-02")
    found = {r["page_id"]: (r["product_id"], r["match_type"], r["gtin"], r["brand"], r["mpn"]) for r in made.results.collect()}
    assert found[1] == ("p1", "gtin_exact", "0012", None, None) and found[2][:2] == ("p2", "mpn_brand") and found[4][:3] == ("p3", "gtin_exact", "0099")
    assert found[3][1] == "new_product" and found[3][2:] == (None, None, None)


def plain_shop(spark, sf, as_of):
    """The batch of the shop queries, page by page and offer by offer; what a page and a reply say is taken from the operators that are tested by themselves."""
    from pricetide.functions.text import page_title
    from pricetide.operators import catalog, compliance
    from pricetide.queries import shop_inputs
    from tests.test_cases import plain_fuzzy
    from pyspark.sql import functions as F

    pages, said, sources, products, stored = shop_inputs(spark, sf)
    allowed, why = compliance.source_gate(F.col("source_type"), F.col("status"))
    gates = {r[0]: (r[1], r[2]) for r in sources.select("source_id", allowed, why).collect()}
    told = {r["page_id"]: r.asDict() for r in shopping.resolve_offers(pages, said).collect()}
    names = spark.createDataFrame([(i, *[r[n] for n in ("product_name", "brand", "mpn", "sku", "model_number", "gtin")]) for i, r in told.items()], "in_id long, title string, brand string, mpn string, sku string, model_number string, gtin string")
    norm = {r["in_id"]: r.asDict() for r in catalog.normalize_products(names).collect()}
    walls = {r[0]: r[1] for r in pages.select("page_id", compliance.classify_block(F.col("page_text"), F.col("http_status"), F.col("url"))).collect()}
    marks = {k: m for k, m, _ in compliance.PROFILES}
    known = products.collect()
    results, fresh, left, seen = {}, {}, [], []
    for p in pages.collect():
        gate = gates.get(p["source_id"], (False, "source_not_active"))
        blob = [(p[c] or "")[:120_000].lower() for c in ("html", "page_text")]
        usable = p["fetch_backend"] == "browser_grid" or p["retailer_key"] not in marks or any(m.lower() in b for m in marks[p["retailer_key"]] for b in blob)
        error = gate[1] if not gate[0] else walls[p["page_id"]] if p["tier"] >= 4 and walls[p["page_id"]] != "ok" else "fetch_failed" if p["status"] != "ok" else None if usable else "no_product_markers"
        if error:
            results[p["page_id"]] = (None, None, error, None, None)
        else:
            seen.append((p, told[p["page_id"]], norm[p["page_id"]]))
    for p, r, n in seen:
        hits = [("gtin_exact", [k["product_id"] for k in known if n["gtin"] and k["gtin"] == n["gtin"]]), ("normalized_key", [k["product_id"] for k in known if n["normalized_key"] and k["normalized_key"] == n["normalized_key"]])]
        model = n["mpn"] or n["model_number"]
        hits.insert(1, ("mpn_brand", [k["product_id"] for k in known if n["brand"] and model and (k["brand"] or "").lower() == n["brand"].lower() and k["mpn"] == model]))
        match = next(((str(min(ids)), kind) for kind, ids in hits if ids), None)
        results[p["page_id"]] = (r["price"], r["price_source"], r["error"], *(match or (None, None)))
        if match is None:
            left.append((p["page_id"], n))
    fuzzy = plain_fuzzy([(i, n["canonical_title"], n["brand"]) for i, n in left], [(k["product_id"], k["canonical_title"], k["brand"]) for k in known])
    for i, n in sorted(left, key=lambda x: x[0]):
        if i in fuzzy:
            match = (str(fuzzy[i][0]), "fuzzy_title")
        elif n["normalized_key"] is None:
            match = (None, None)
        else:
            kind = "normalized_key" if n["normalized_key"] in fresh else "new_product"
            fresh.setdefault(n["normalized_key"], n["canonical_title"])
            match = (hashlib.sha256(n["normalized_key"].encode()).hexdigest(), kind)
        results[i] = (*results[i][:3], *match)
    offers = {(o["source_id"], o["title"]): o.asDict() for o in stored.collect()}
    history = []
    for (source, title), rows in groupby(sorted(((p["source_id"], r["product_name"] or "Unknown"), p["page_id"], p, r) for p, r, _ in seen), key=lambda x: x[0]):
        rows = list(rows)
        _, page, p, r = rows[-1]
        o = offers.get((source, title))
        if o is None:
            o = offers[source, title] = {"offer_id": hashlib.sha256(f"{source}|{title}".encode()).hexdigest(), "source_id": source, "title": title, "product_id": results[page][3], "price": r["price"], "availability": r["availability"], "url": r["product_url"] or p["url"]}
        else:
            o["price"] = o["price"] if r["price"] is None else r["price"]
            o["url"] = r["product_url"] or o["url"]
        o["last_seen_at"] = as_of
        history += [(o["offer_id"], x["price"], x["availability"]) for *_, x in rows if x["price"] is not None]
    return results, fresh, offers, history


def test_shop_batch_equals_a_plain_version(spark):
    from pricetide import queries as q

    sf = "/root/testdata/sf0.01"
    results, fresh, offers, history = plain_shop(spark, sf, datetime.fromisoformat(q.AS_OF))
    made = q._shopped(spark, sf)
    found = {r["page_id"]: (r["price"], r["price_source"], r["error"], r["product_id"], r["match_type"]) for r in made.results.collect()}
    assert found == results
    kinds = {r[4] for r in results.values()} | {r[2] for r in results.values()}
    assert {"mpn_brand", "new_product", "no_product_markers", "fetch_failed"} <= kinds, kinds
    assert {r["normalized_key"]: r["canonical_title"] for r in made.products.collect()} == fresh
    columns = ("offer_id", "product_id", "price", "availability", "url", "last_seen_at")
    assert {(r["source_id"], r["title"]): tuple(r[c] for c in columns) for r in made.offers.collect()} == {k: tuple(o[c] for c in columns) for k, o in offers.items()}
    assert sorted((r["offer_id"], r["price"], str(r["availability"])) for r in made.history.collect()) == sorted((a, b, str(c)) for a, b, c in history)
