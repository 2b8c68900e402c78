"""Whole workloads put together from the operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricetide.functions.prices import html_price_candidates, merge_candidates, text_price_candidates, to_price
from pricetide.functions.text import page_title, sanitize_text, text_or_empty
from pricetide.operators import catalog, compliance, listings, ranking, replies
from pricetide.sources.work import materialize

#: What names a product, and what a page's own product fields are called beside its other columns.
NAMES = ("brand", "mpn", "sku", "model_number", "gtin")
PAGE_FIELDS = ("title", "price", "availability", "rating", "review_count", "brand", "mpn", "sku", "gtin")


def priced_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, query, retailer_key, candidates and the page's own product fields (page_title, page_price, ...).

    Html is reduced to them before anything is shuffled.
    """
    found = merge_candidates(html_price_candidates(F.col("html"), F.col("retailer_key")), text_price_candidates(sanitize_text(F.col("page_text"))))
    rows = listings.product_fields(pages.select("page_id", "url", "query", "retailer_key", "html", "page_text", found.alias("candidates")))
    return rows.select("page_id", "url", "query", "retailer_key", "candidates", *[F.col(c).alias(f"page_{c}") for c in PAGE_FIELDS])


def merged_by_page(raw_replies: DataFrame) -> DataFrame:
    """page_id, query, reply (and panel, if a page has several) -> page_id, query, parsed (JSON), error: one row a page.

    The reply of a page that has one is taken as it is; several are merged, and their errors only count if all have one.
    """
    told = raw_replies if "panel" in raw_replies.columns else raw_replies.withColumn("panel", F.lit(0))
    parsed = replies.parse_replies(told)
    parsed = parsed.withColumn("error", F.coalesce("error", F.get_json_object("parsed", "$._error")))
    pages = parsed.groupBy("page_id").agg(
        F.min("query").alias("query"), F.count(F.lit(1)).alias("_n"), F.min_by("parsed", "panel").alias("_one"),
        F.count_if(F.col("error").isNull()).alias("_good"), F.min_by("error", "panel").alias("_error"),
    )
    merged = replies.merge_partials(parsed.where("parsed is not null").select("page_id", "panel", "parsed"))
    rows = pages.join(merged, "page_id", "left")
    return rows.select("page_id", "query", F.when(F.col("_n") == 1, F.col("_one")).otherwise(F.col("merged")).alias("parsed"), F.when(F.col("_good") == 0, F.col("_error")).alias("error"))


def resolve_offers(pages: DataFrame, raw_replies: DataFrame) -> DataFrame:
    """Pages and model replies (page_id, query, reply) -> one resolved price for each page, with where it came from.

    A page that neither its reply nor its candidates price falls back on its own product fields. Brand, mpn, sku, model_number
    and gtin are the reply's; the page's own fill in where the product is the one that the page names.
    """
    said = merged_by_page(raw_replies)
    best = replies.reply_to_shop(said.where("parsed is not null").withColumn("payload_id", F.col("page_id")))
    best = best.select("payload_id", F.col("product_name").alias("_name"), F.col("price").alias("listing_price"), "original_price", "seller", "product_url")
    get = lambda path: F.get_json_object("parsed", path)
    said = said.select(
        F.col("page_id").alias("_p"), get("$.price").try_cast("double").alias("reply_price"), F.coalesce(get("$.product_name"), get("$.title")).alias("_told"), F.col("error").alias("reply_error"),
        get("$.availability").alias("_availability"), get("$.rating").try_cast("double").alias("_rating"), get("$.review_count").try_cast("int").alias("_reviews"),
        *[F.nullif(get(f"$.{n}"), F.lit("")).alias(f"_{n}") for n in NAMES],
    )
    rows = priced_pages(pages).withColumn("page_price", to_price(F.col("page_price").cast("string")))
    rows = rows.join(said, F.col("page_id") == F.col("_p"), "left").join(best, F.col("page_id") == F.col("payload_id"), "left")
    rows = listings.resolve_price(rows)
    own = F.coalesce(F.col("price_source") == "html_extract", F.lit(False))
    out = {
        "product_name": F.when(own, F.col("page_title")).otherwise(F.coalesce("_name", "_told")),
        "availability": F.when(own, F.col("page_availability")).otherwise(F.col("_availability")),
        "rating": F.when(own, F.col("page_rating")).otherwise(F.col("_rating")),
        "review_count": F.when(own, F.col("page_review_count")).otherwise(F.col("_reviews")),
        "product_url": F.when(own, F.col("url")).otherwise(F.col("product_url")),
    }
    same = own | F.coalesce(F.lower("page_title") == F.lower(out["product_name"]), F.lit(False))
    for n in NAMES:
        out[n] = F.coalesce(F.col(f"_{n}"), F.when(same, F.nullif(F.col(f"page_{n}"), F.lit("")))) if n in PAGE_FIELDS else F.col(f"_{n}")
    kept = ("page_id", "url", "query", "retailer_key", "candidates", "price", "price_source", "error", "original_price", "seller")
    return rows.select(*kept, *[c.alias(k) for k, c in out.items()])


class Shopping(NamedTuple):
    """What one batch of pages makes: a row for each page, products new to the catalog, all offers after it, its price history."""

    results: DataFrame
    products: DataFrame
    offers: DataFrame
    history: DataFrame


def usable(pages: DataFrame) -> DataFrame:
    """pages with ``_usable`` (see ``compliance.usable_pages``); a page's title is its html's where it has no column of its own."""
    have = pages.columns
    seen = pages.select(
        "page_id", "retailer_key", "status", "html", F.col("page_text").alias("text"), F.length(text_or_empty(F.col("page_text"))).alias("char_count"),
        F.col("title") if "title" in have else page_title(F.col("html")).alias("title"), F.col("fetch_backend") if "fetch_backend" in have else F.lit(None).cast("string").alias("fetch_backend"),
        F.struct(*[F.col(f"`{c}`") for c in have]).alias("_page"),
    )
    rows = compliance.usable_pages(seen, compliance.profiles(pages.sparkSession))
    return rows.select("_page.*", F.col("usable").alias("_usable"))


def pages_to_offers(pages: DataFrame, raw_replies: DataFrame, sources: DataFrame, products: DataFrame, offers: DataFrame, as_of: str) -> Shopping:
    """Usable fetched pages of sources that may be used and did not stop at a wall, to resolved, matched and stored offers.

    pages: page_id, url, html, page_text, query, retailer_key, source_id, status, http_status, tier, and fetch_backend and title
    where they are known; sources: source_id, source_type, status. Pages that drop out have their reason in the results and no
    offer. Resolved pages and matches are work tables, so that later steps don't scan pages again; the caller stores what is
    returned.
    """
    allowed, why = compliance.source_gate(F.col("source_type"), F.col("_source_status"))
    gated = pages.join(sources.select("source_id", "source_type", F.col("status").alias("_source_status")), "source_id", "left")
    wall = compliance.classify_block(F.col("page_text"), F.col("http_status"), F.col("url"))
    _, stop = compliance.escalation_decision(F.col("_wall"), F.col("tier"))
    gated = usable(gated.withColumn("_wall", wall))
    gone = F.when(~allowed, why).when(stop, F.col("_wall")).when(F.coalesce(F.col("status"), F.lit("")) != "ok", "fetch_failed").when(~F.col("_usable"), "no_product_markers")
    gated = gated.withColumn("_gone", gone)
    resolved = materialize(resolve_offers(gated.where("_gone is null"), raw_replies), "resolved")
    seen = resolved.join(gated.select(F.col("page_id").alias("_p"), "source_id"), F.col("page_id") == F.col("_p")).drop("_p")
    known = catalog.normalize_products(seen.select(F.col("page_id").alias("in_id"), F.col("product_name").alias("title"), *NAMES))
    known = materialize(known, "known")
    matched = materialize(match_products(known, products), "matched")
    seen = seen.join(matched.select(F.col("in_id").alias("page_id"), "product_id", "match_type", "confidence", "needs_review"), "page_id", "left")
    seen = materialize(seen, "seen")
    fresh = known.join(matched.where("match_type = 'new_product'").select("in_id", "product_id"), "in_id")
    fresh = fresh.select("product_id", "canonical_title", "brand", "model_number", "mpn", "gtin", "normalized_key")
    moment = F.lit(as_of).cast("timestamp")
    incoming = seen.select(
        "source_id", F.col("product_name").alias("title"), "product_id", "price", "availability", "rating", "review_count",
        F.col("product_url").alias("url"), F.col("url").alias("page_url"), moment.alias("observed_at"), F.col("page_id").alias("seq"),
    )
    stored = materialize(catalog.upsert_offers(offers, incoming, as_of), "offers")
    ids = stored.select(F.col("source_id").alias("_s"), F.col("title").alias("_t"), "offer_id")
    observed = incoming.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown"))).withColumn("captured_at", F.col("observed_at"))
    history = catalog.append_price_history(observed.join(ids, (F.col("source_id") == F.col("_s")) & (F.col("title") == F.col("_t"))))
    lost = gated.where("_gone is not null").select("page_id", "url", "query", "retailer_key", "source_id", F.col("_gone").alias("error"))
    return Shopping(seen.unionByName(lost, allowMissingColumns=True), fresh, stored, history)


def match_products(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """in_id, product_id (text), match_type, confidence, needs_review: exact keys, then similar titles, then new products.

    Of rows that make one new product the first is it, and the others match it by their key.
    """
    exact = catalog.match_exact(incoming, products)
    rest = exact.where("product_id is null").drop("product_id", "match_type", "confidence")
    fuzzy = catalog.match_fuzzy(rest, products)
    left = rest.join(fuzzy.select("in_id"), "in_id", "left_anti").where("normalized_key is not null")
    first = catalog.new_products(left)
    again = left.join(first.select("in_id"), "in_id", "left_anti").select(
        "in_id", F.sha2("normalized_key", 256).alias("product_id"), F.lit("normalized_key").alias("match_type"), F.lit(catalog.CONFIDENCE["normalized_key"]).alias("confidence")
    )
    shape = lambda d, review: d.select("in_id", F.col("product_id").cast("string").alias("product_id"), "match_type", "confidence", review.alias("needs_review"))
    found = shape(exact.where("product_id is not null"), F.lit(False)).unionByName(shape(fuzzy, F.col("needs_review")))
    return found.unionByName(shape(first, F.lit(False))).unionByName(shape(again, F.lit(False)))


def ranked_offers(offers: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    return ranking.rank_offers(ranking.score_offers(offers, ["product_id"], as_of, small_groups=True), ["product_id"], k)
